"""Connected components of a link table, by alternating large and small stars.

Kiveris et al., "Connected components in MapReduce and beyond", 2014: every round replaces the links about each
node by links to the smallest node it knows, until the links are one star per component. A node with very
many links costs a partial minimum and a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilescope.llm.common import written_once


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    near = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link to another; the root is its component's smallest node.

    ``links`` has two long columns ``u`` and ``v``; direction, repeats and links to itself don't matter; links
    with a null are no links. No rows give no rows.
    """
    links = links.dropna().where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = written_once(links, "links")
    before = _print(links)
    while True:
        # A large star leaves u > v, as the small one expects.
        links = written_once(_small_star(_large_star(links)), "stars")
        after = _print(links)
        if after == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                links.select("v", "v").distinct()
            )
        before = after
