import random

import numpy as np
import pytest
from profilescope.llm import neardup
from profilescope.llm.components import components
from profilescope.llm.neardup import cluster, op7, without_near_duplicates
from profilescope.llm.sketching import Shingler, Sketcher
from pyspark.sql import functions as F

from .conftest import COLUMNS, words


def shingles(text, width):
    found = (text or "").lower().split()
    return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


def brute(rows, width, similarity=80):
    """Component of each (place, doc_id, text) by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= similarity * (len(sets[i]) + len(sets[j]) - common) and sets[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def edited(rng, text, n):
    parts = text.split()
    for _ in range(n):
        parts[rng.randrange(len(parts))] = f"neu{rng.randrange(10**6)}"
    return " ".join(parts)


@pytest.fixture(scope="module")
def family():
    """Copies of two texts with few to many edits, some of which no direct link reaches."""
    rng = random.Random(5)
    base, other = words(11, 90), words(12, 70)
    texts = [edited(rng, base, rng.randrange(9)) for _ in range(90)] + [edited(rng, other, rng.randrange(7)) for _ in range(20)]
    texts += [words(100 + i, 40) for i in range(20)] + texts[:5]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("large,block", [(64, 256), (8, 5), (10**6, 3)])
def test_components_match_brute_force(spark, family, monkeypatch, large, block):
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = spark.createDataFrame(family, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in op7(docs).collect()}
    want = brute(family, 2)
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(want))
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert all(r["n_shingles"] == len(shingles(family[i][1], 2)) for i, r in got.items())


def test_near_copy_outside_the_large_bucket(spark, monkeypatch):
    """A class of a large open bucket meets its near copy only in a small one, whose centre is like neither."""
    rng = random.Random(8)
    text = words(21, 90)
    texts = [words(22, 90), text, edited(rng, text, 3)] + [words(30 + i, 60) for i in range(12)]
    real = neardup.sketched

    def with_bands(docs, width):
        """In the first band the second text meets the last twelve, in the next one the first three meet."""
        i = F.col("_document.doc_id")
        bands = F.transform(F.sequence(F.lit(1), F.lit(42)), lambda b: 1000 * (i + 1) + b)
        first, second = F.when((i == 1) | (i > 2), F.lit(1)), F.when(i < 3, F.lit(2))
        bands = F.concat(F.array(*[F.coalesce(f, bands[n]) for n, f in enumerate((first, second))]), F.slice(bands, 3, 40))
        return real(docs, width).withColumn("_bands", bands.cast("array<bigint>"))

    monkeypatch.setattr(neardup, "sketched", with_bands)
    monkeypatch.setattr(neardup, "LARGE", 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in op7(docs).collect()}
    want = brute(list(enumerate(texts)), 2)
    assert want[2] == 1 and got == dict(enumerate(want))


def test_odd_documents(odd, odd_rows, none):
    rows = cluster(odd, 5).collect()
    assert len(rows) == len(odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["component_id"], r["first"], r["n_shingles"]))
    assert by[1][0][:2] == (1, True)
    assert by[2][0][:2] == by[3][0][:2] == (1, False)
    assert by[4] == [(4, True, 0)] and by[5] == [(5, True, 0)] and by[6] == [(6, True, 0)]
    assert sorted(x[1] for x in by[8]) == [False, True, True]  # the repeated row goes, the other text stays
    assert {x[0] for x in by[8]} == {8}
    assert sorted(by[None], key=str) == [(None, True, 0), (None, True, 36)]
    assert by[9] == [(9, True, 1)]
    assert cluster(none).count() == 0
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 3
    assert {r["_row"] for r in kept.collect()} == {"clash"}
    assert op7(odd).where("kept IS NULL").count() == 0


def test_sketches_estimate_similarity():
    sketcher, rng = Sketcher(252), np.random.default_rng(1)
    for n in (1, 2, 7, 90, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (sketcher.sketch(a) < np.iinfo(np.uint64).max).all()
        assert (sketcher.sketch(a) == sketcher.sketch(a.copy())).all()
    shared = rng.integers(0, 2**63, 800).astype(np.uint64)
    found = []
    for _ in range(20):
        a, b = (np.concatenate([shared, rng.integers(0, 2**63, 100).astype(np.uint64)]) for _ in range(2))
        found.append((sketcher.sketch(a) == sketcher.sketch(b)).mean())
    assert abs(np.mean(found) - 0.8) < 0.03


def test_shingler_matches_definition():
    rng = random.Random(2)
    for _ in range(30):
        text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(12)))
        assert len(Shingler(3).shingles(text)) == len(shingles(text, 3))


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (7, None), (10, 11), (11, 12), (12, 13), (13, 14), (14, 10), (2, 1)]
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {tuple(r) for r in got} == {(i, 1) for i in (1, 2, 3)} | {(4, 4), (5, 4)} | {(i, 10) for i in range(10, 15)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fewer_words_than_a_shingle(spark):
    docs = spark.createDataFrame([(1, "a b", "", "", 1), (2, "A  b", "", "", 1), (3, "a b c", "", "", 1)], COLUMNS)
    assert [r["component_id"] for r in cluster(docs, 5).orderBy("doc_id").collect()] == [1, 1, 3]
