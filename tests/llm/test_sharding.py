import zlib

import pytest
from profilescope.llm.sharding import PRIME, grid, op3, position, round_keys, shuffle_documents
from pyspark.sql import functions as F


def permuted(x, rows, seed):
    """One pass of the network, told again in plain Python."""
    a, b = grid(rows)
    left, right = x % a, x // a
    for i, (m, c) in enumerate(round_keys(seed)):
        source = right if i % 2 == 0 else left
        mixed = (source * m + c) % PRIME
        word = ((mixed % 46337) * (mixed % 46309) + c) % PRIME
        if i % 2 == 0:
            left = (left + word) % a
        else:
            right = (right + word) % b
    return right * a + left


def walked(x, rows, seed):
    x = permuted(x, rows, seed)
    while x >= rows:
        x = permuted(x, rows, seed)
    return x


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 24, 101, 1000])
def test_positions_are_a_permutation(spark, rows):
    got = spark.range(rows).select(position(F.col("id"), rows, 99).alias("p"), "id").collect()
    assert {r["id"]: r["p"] for r in got} == {x: walked(x, rows, 99) for x in range(rows)}
    assert sorted(r["p"] for r in got) == list(range(rows))


def test_law_and_contract(odd, odd_rows, none):
    rows = op3(odd).collect()
    assert len(rows) == len(odd_rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by_shard.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    want = sorted(
        (repr(i), 8 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode())) for i, t, *_ in odd_rows
    )
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(want, key=lambda r: (r[0], r[1]))
    assert op3(none).count() == 0


def test_the_same_however_it_is_stored(odd):
    first = sorted(map(repr, shuffle_documents(odd).collect()))
    assert first == sorted(map(repr, shuffle_documents(odd.repartition(7)).collect()))


def test_many_copies_are_numbered_once_each(spark):
    docs = spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("same").alias("text"))
    rows = shuffle_documents(docs).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(3000))
