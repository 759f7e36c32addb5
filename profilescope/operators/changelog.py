"""Change-log compaction: the latest document per key, without deleted ones.

``max_by`` combines before the shuffle, so a key with a third of all changes sends one row per task and
no task ever gathers the history of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilescope.operators.joins import is_small

SEQUENCE = "_seq"
OP = "_op"
UPSERT, DELETE = "upsert", "delete"


def latest_changes(changes: DataFrame, key: str, sequence: Column | str = SEQUENCE) -> DataFrame:
    """The last change of each key, tombstones included."""
    others = [c for c in changes.columns if c != key]
    newest = F.max_by(F.struct(*others), sequence).alias("_newest")
    return changes.groupBy(key).agg(newest).select(key, "_newest.*").select(*changes.columns)


def latest(
    changes: DataFrame,
    key: str,
    sequence: Column | str = SEQUENCE,
    deleted: Column | None = None,
) -> DataFrame:
    """The current documents of a change log."""
    gone = F.col(OP) == DELETE if deleted is None else deleted
    return latest_changes(changes, key, sequence).where(~F.coalesce(gone, F.lit(False)))


def merge_snapshot(
    snapshot: DataFrame,
    tail: DataFrame,
    key: str,
    sequence: Column | str = SEQUENCE,
    keep_deleted: bool = False,
    few: bool | None = None,
) -> DataFrame:
    """A snapshot (one row per key) brought up to date with the changes after it.

    Where the tail has few rows (``few``; counted, if not told), its keys are broadcast: rows of the snapshot that
    it doesn't name are passed on where they are, and only the rest meets the tail. A longer tail and the snapshot are
    dealt out by key once. Late changes with an older sequence lose either way. With ``keep_deleted`` tombstones stay
    in the result, so that they go on hiding late changes.
    """
    snapshot = snapshot.select(*tail.columns)
    if is_small(tail.select(key)) if few is None else few:
        changed = F.broadcast(tail.select(key).distinct())
        touched = snapshot.join(changed, key, "left_semi").select(*tail.columns)
        untouched = snapshot.join(changed, key, "left_anti").select(*tail.columns)
        merged = untouched.unionAll(latest_changes(touched.unionAll(tail), key, sequence))
    else:
        merged = latest_changes(snapshot.unionAll(tail), key, sequence)
    return merged if keep_deleted else merged.where(~F.coalesce(F.col(OP) == DELETE, F.lit(False)))


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows but those of the given keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti")
