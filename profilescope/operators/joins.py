"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilescope.session import COMPRESSION, scratch_path

SALTS = 16
BROADCAST_ROWS = 50_000  # narrow rows of a token or an id
BROADCAST_REQUESTS = 5_000  # whole requests, a kilobyte or so each


def is_small(rows: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``most`` rows; counts no further than that."""
    return rows.limit(most + 1).count() <= most


def hot_join(large: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], fits: bool) -> DataFrame:
    """Inner equi-join in which no key of ``large`` has to fit one task.

    Where ``small`` was found to fit (see ``is_small``) it is broadcast and ``large`` does not move.
    Otherwise rows of ``large`` are spread over salts by the hash of ``spread_by``, rows of ``small`` are
    repeated once per salt, and a merge join, which spills, takes both.
    """
    if fits:
        return large.join(F.broadcast(small), keys)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("_salt", salt).join(repeated.hint("merge"), [*keys, "_salt"]).drop("_salt")


def written_once(rows: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder, for rows that several branches of a plan read.

    They are then computed once, their size is known to the planner, and losing an executor later costs
    no second computation.
    """
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path, compression=COMPRESSION)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
