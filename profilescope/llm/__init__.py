"""Training-data operators: classifiers, filters, sharding, scoring, deduplication, packing."""
