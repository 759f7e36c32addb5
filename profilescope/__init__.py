"""Search, matching and change-log maintenance for large tables of nested profile documents."""
