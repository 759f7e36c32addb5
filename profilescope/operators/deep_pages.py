"""Pages at any offset, by order statistics instead of one long sort.

A page that starts far down needs all rows before it counted, not sorted. A bounded sample of sort keys, the same
in every run, cuts the order into ranges; one pass counts the rows of each range; only the ranges that hold the
page are kept. That is repeated inside them until what is left before and in the page is short enough to sort. Nothing is
shuffled but counts, and no task gets more rows than that.

A row finds its range by halving, and what a round keeps is written before the next one reads it, so the input is read three
times, however many rounds there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilescope.operators.joins import written_once

#: Rows up to the end of a page that one task may sort, sampled keys, and ranges.
SHALLOW, SAMPLE, RANGES = 10_000, 4096, 1024


@dataclass(frozen=True)
class Key:
    """A sort key; nulls are smaller than all values."""

    name: str
    descending: bool = False

    def column(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.descending else F.col(self.name).asc_nulls_first()


def _runs(keys: list[Key]) -> list[tuple[bool, list[str]]]:
    """Successive keys of one direction. They compare as a struct, whose nulls are smaller than all values too."""
    return [(down, [k.name for k in run]) for down, run in groupby(keys, lambda k: k.descending)]


def _in_runs(keys: list[Key]) -> Column:
    return F.struct(*(F.struct(*names).alias(f"r{i}") for i, (_, names) in enumerate(_runs(keys))))


def _before(keys: list[Key], row: Column, bound: Column) -> Column:
    """Whether a row comes before a row with the bound's keys, both as ``_in_runs`` makes them."""
    found = F.lit(False)
    for i, (down, _) in reversed(list(enumerate(_runs(keys)))):
        own, other = row[f"r{i}"], bound[f"r{i}"]
        found = (own > other if down else own < other) | ((own == other) & found)
    return found


def _listed(rows: DataFrame, keys: list[Key], bounds: list[Row]) -> Column:
    """Bounds as one array, which is read once and is no part of the plan's expressions."""
    schema = T.StructType([rows.schema[k.name] for k in keys])
    wrapped = T.StructType([T.StructField("bounds", T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in schema])))])
    listed = rows.sparkSession.createDataFrame([([tuple(b) for b in bounds],)], wrapped)
    fields = "named_struct({})".format(
        ", ".join(
            f"'r{i}', named_struct({', '.join(f'{name!r}, b.`{name}`' for name in names)})" for i, (_, names) in enumerate(_runs(keys))
        )
    )
    return listed.select(F.expr(f"transform(bounds, b -> {fields})")).scalar()


def _placed(rows: DataFrame, keys: list[Key], bounds: list[Row]) -> DataFrame:
    """``place``: how many bounds don't come after the row, found by halving."""
    listed = _listed(rows, keys, bounds)
    found = rows.select(_in_runs(keys).alias("row"), F.lit(0).alias("place"))
    for half in (1 << i for i in reversed(range(len(bounds).bit_length()))):
        # Beyond the last bound there is none, and nothing is added.
        found = found.withColumn("bound", F.get(listed, F.col("place") + F.lit(half - 1)))
        passed = F.col("bound").isNotNull() & ~_before(keys, F.col("row"), F.col("bound"))
        found = found.withColumn("place", F.col("place") + F.when(passed, F.lit(half)).otherwise(F.lit(0)))
    return found.select("place")


def _between(rows: DataFrame, keys: list[Key], bounds: list[Row], first: int, last: int) -> DataFrame:
    """The rows whose place is ``first`` to ``last``."""
    ends = [(bounds[first - 1], True)] if first else []
    ends += [(bounds[last], False)] if last < len(bounds) else []
    if ends:
        listed = _listed(rows, keys, [bound for bound, _ in ends])
        tests = [_before(keys, _in_runs(keys), listed[i]) for i in range(len(ends))]
        for test, (_, lower) in zip(tests, ends, strict=True):
            rows = rows.where(~test if lower else test)
    return rows


def _comparable(rows: DataFrame, keys: list[Key]) -> DataFrame:
    """Instants as numbers, so that bounds mean the same in the driver and in tasks."""
    instants = [k.name for k in keys if isinstance(rows.schema[k.name].dataType, (T.TimestampType, T.TimestampNTZType))]
    return rows.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in instants}) if instants else rows


def key_page(rows: DataFrame, keys: list[Key], offset: int, size: int) -> DataFrame:
    """The rows (of nothing but their keys) from place ``offset`` on, ``size`` of them, in order.

    Keys must not leave ties whose order matters. Places after the last row give no rows.
    """
    rows = _comparable(rows.select(*(k.name for k in keys)), keys)
    order = [k.column() for k in keys]
    rounds = 0
    while offset + size > SHALLOW:
        if rounds:
            rows = written_once(rows, "ranges")
        rounds += 1
        sample = rows.orderBy(F.xxhash64(*(k.name for k in keys)), *order).limit(SAMPLE)
        found = sample.orderBy(*order).collect()  # at most SAMPLE rows of keys
        bounds = list(dict.fromkeys(found[i * len(found) // RANGES] for i in range(1, RANGES) if found))
        if not bounds:
            break
        counted = dict(_placed(rows, keys, bounds).groupBy("place").count().collect())  # a number for each range
        kept, start, before = [], 0, 0
        for number in range(len(bounds) + 1):
            end = start + counted.get(number, 0)
            if end <= offset:
                before = end
            elif start < offset + size:
                kept.append(number)
            start = end
        if not kept:
            return rows.limit(0)
        rows, offset = _between(rows, keys, bounds, kept[0], kept[-1]), offset - before
        if len(kept) > len(bounds) or (before == 0 and sum(counted.get(n, 0) for n in kept) == sum(counted.values())):
            break  # the page is most of the rows
    return rows.orderBy(*order).offset(offset).limit(size)
