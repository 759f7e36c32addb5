"""Operator 3: reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows get gapless numbers in a fixed order. A keyed Feistel network over a grid of ``a * b`` cells, the
smallest near-square one with at least as many cells as rows, permutes the numbers; a number that falls
outside the table is permuted again until it falls inside (cycle walking). The result p is a position of a
shuffle of the whole table: shard p mod n, slot p div n. So shard sizes differ by one row at most, and shard and
slot of a row number can be computed without the table, as can the row number of a slot.

Everything is DataFrame expressions. Numbers come from 4,096 buckets of a content hash: the buckets' counts,
summed in order, are their first numbers. Equal rows are one row with a count until they are numbered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
PRIME = 2147483647  # of the round function; products stay below 2^63
BUCKETS = 4096
#: Copies of a row that one array of numbers holds while they are numbered.
COPIES = 1 << 16
#: Walks in the first expression; more are made only for the rows that need them.
SHORT_WALK, LONG_WALK = 2, 400


def grid(rows: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square grid with a * b >= rows; at least 2 by 2, where rounds can mix."""
    a = max(2, math.isqrt(max(rows, 1)))
    return a, max(2, -(-rows // a))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A multiplier and an addend below the prime for each round, from the seed alone."""
    state, keys = seed % PRIME + 1, []
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            state = (state * 48271 + 11) % PRIME  # fixed value: the minimal-standard generator
            pair.append(state or 1)
        keys.append((pair[0], pair[1]))
    return keys


def permute(x: Column, rows: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One application of the network, each round computed once."""
    a, b = grid(rows)
    pair = F.struct(F.pmod(x, F.lit(a)).alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))

    def step(i: int, m: int, c: int, p: Column) -> Column:
        source, target, side = (p["r"], p["l"], a) if i % 2 == 0 else (p["l"], p["r"], b)
        mixed = (source * F.lit(m).cast("long") + F.lit(c).cast("long")) % F.lit(PRIME).cast("long")
        word = ((mixed % 46337) * (mixed % 46309) + F.lit(c)) % F.lit(PRIME).cast("long")
        moved = (target + word) % F.lit(side).cast("long")
        return F.struct((moved if i % 2 == 0 else p["l"]).alias("l"), (p["r"] if i % 2 == 0 else moved).alias("r"))

    for i, (m, c) in enumerate(round_keys(seed, rounds)):
        pair = _bound(pair, _of_pair(step, i, m, c))
    return _bound(pair, lambda p: p["r"] * F.lit(a).cast("long") + p["l"])


def _of_pair(step, i: int, m: int, c: int):
    return lambda pair: step(i, m, c, pair)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def position(number: Column, rows: int, seed: int) -> Column:
    """The shuffled place of a row number: walked until it is below ``rows``.

    At most ``a * b - rows`` numbers lie outside, so a walk is no longer than that; grids waste less than
    one side, and a walk of ``LONG_WALK`` steps has a probability of about rows^(-LONG_WALK / 2). Should one
    ever be longer, the job fails instead of giving a wrong place.
    """
    a, b = grid(rows)
    outside = a * b - rows
    first = permute(number, rows, seed)
    if not outside:
        return first
    again = lambda x: F.when(x < rows, x).otherwise(permute(x, rows, seed))
    walk = lambda x, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), x, lambda at, _: again(at))
    short = walk(first, min(outside, SHORT_WALK))
    if outside <= SHORT_WALK:
        return short
    return _bound(
        _bound(short, lambda x: F.when(x < rows, x).otherwise(walk(x, min(outside, LONG_WALK)))),
        lambda x: F.when(x < rows, x).otherwise(F.raise_error(F.lit("a cycle is too long")).cast("long")),
    )


def number_rows(rows: DataFrame, order: list[str], content: str) -> DataFrame:
    """Adds ``row_number``: gapless from 0, the same for the same rows however they are stored.

    ``content`` names a column with a hexadecimal digest of the row; rows are ordered by its first three
    digits, then ``order``, then the digest. Rows equal in all columns are counted first, so that no number of copies
    meets in one task.
    """
    columns = rows.columns
    bucket = F.expr(f"cast(conv(substr({content}, 1, 3), 16, 10) AS int)")
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", bucket)
    sizes = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_size"))
    # At most 4,096 rows of two numbers, whatever the table's size.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    place = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order], content)
    earlier = F.coalesce(F.sum("_copies").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES).cast("long")))
    rest = F.least(F.lit(COPIES), F.col("_copies") - F.col("_chunk") * COPIES) - 1
    return (
        counted.withColumn("_earlier", earlier)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("_chunk", chunk)
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), rest)))
        .select(*columns, F.expr(f"_offset + _earlier + _chunk * {COPIES} + _copy").alias("row_number"))
    )


def shard(numbered: DataFrame, rows: int, shards: int, seed: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows with gapless ``row_number`` below ``rows``."""
    place = position(F.col("row_number"), rows, seed)
    return (
        numbered.withColumn("_place", place)
        .withColumn("shard", F.expr(f"cast(_place % {shards} AS int)"))
        .withColumn("slot", F.expr(f"_place div {shards}"))
        .drop("_place")
    )


def shuffle_documents(docs: DataFrame, shards: int = 24, seed: int = 20_240_229) -> DataFrame:
    """All documents with their size, digest, row number, shard and slot.

    Columns: doc_id, size (UTF-8 bytes plus 8), text_crc32, digest (of id and text), row_number, shard, slot.
    The size is that of a record of an 8-byte header and the text. Nulls: a null text has size 8 and a null
    checksum; a null id sorts first. Repeated rows get a number each. An empty table gives no rows. Other
    columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.expr("cast(coalesce(octet_length(text), 0) + 8 AS bigint)").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")).alias("digest"),
    )
    return shard(number_rows(rows, ["doc_id"], "digest"), docs.count(), shards, seed)


def op3(docs: DataFrame) -> DataFrame:
    """The contract's columns: shard counts are at most one apart (law ``rows``)."""
    return shuffle_documents(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
