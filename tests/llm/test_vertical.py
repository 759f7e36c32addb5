import random

import pytest
from profilescope.llm import vertical
from profilescope.llm.vertical import joined, op12

from .conftest import COLUMNS, words
from .test_neardup import brute, edited, shingles


@pytest.fixture(scope="module")
def family():
    """Families of copies with no to many edits, passages that many texts share, texts alone."""
    rng = random.Random(3)
    texts = []
    for seed, size, copies, edits in ((41, 120, 70, 7), (42, 300, 30, 14), (43, 60, 40, 4), (44, 25, 10, 2)):
        base = words(seed, size)
        texts += [edited(rng, base, rng.randrange(edits)) for _ in range(copies)]
    passage = words(45, 50)
    texts += [f"{words(200 + i, 8)} {passage}" for i in range(40)] + [f"{passage} {words(300 + i, 90)}" for i in range(20)]
    texts += [words(400 + i, 40) for i in range(20)] + texts[:5] + ["a b", "A\tb", "c"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("buffered,frequent,bucket,block,fragments", [(1 << 20, 8, 1 << 22, 1024, 16), (3000, 4, 900, 5, 3), (500, 10**6, 9000, 2, 1)])
def test_components_match_brute_force(spark, family, monkeypatch, buffered, frequent, bucket, block, fragments):
    for name, value in (("BUFFERED", buffered), ("FREQUENT", frequent), ("BUCKET", bucket), ("BLOCK", block), ("REMEMBERED", 9)):
        monkeypatch.setattr(vertical, name, value)
    docs = spark.createDataFrame(family, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in joined(docs, fragments=fragments).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(brute(family, 5)))
    assert all(r["n_shingles"] == len(shingles(family[i][1], 5)) for i, r in got.items())


@pytest.mark.parametrize("width,similarity", [(1, 60), (3, 95), (2, 100)])
def test_other_widths_and_similarities(spark, family, width, similarity):
    docs = spark.createDataFrame(family, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["component_id"] for r in joined(docs, width, similarity).collect()}
    assert got == dict(enumerate(brute(family, width, similarity)))


def test_small_arrow_batches(spark, family):
    """Runs of one shingle or class that go over many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.createDataFrame(family[:120], "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: r["component_id"] for r in op12(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == dict(enumerate(brute(family[:120], 5)))


def test_fragments_sum_to_the_overlap(spark, family):
    docs = spark.createDataFrame(family, "doc_id long, text string").select("text")
    classes = vertical._classes(vertical._ordered(vertical._laid_out(docs, 5, 7)), 80).cache()
    whole = {r["class"]: set(r["tokens"]) for r in classes.collect()}
    cut = vertical._segments(classes, 4).collect()
    assert len({r["fragment"] for r in cut}) > 1
    parts = {}
    for r in cut:
        assert not parts.setdefault(r["class"], set()) & set(r["tokens"])
        parts[r["class"]] |= set(r["tokens"])
    assert parts == whole
    token_parts = {}
    for r in cut:
        for token in r["tokens"]:
            assert token_parts.setdefault(token, r["fragment"]) == r["fragment"]


def test_odd_documents(odd, odd_rows, none):
    rows = joined(odd).collect()
    assert len(rows) == len(odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["component_id"], r["n_shingles"]))
        assert r["_row"] == r["u"] == r["class"] == "clash"
    assert [x[0][0] for x in (by[1], by[2], by[3])] == [1, 1, 1]
    assert by[4] == [(4, 0)] and by[5] == [(5, 0)] and by[6] == [(6, 0)]
    assert {x[0] for x in by[8]} == {8} and len(by[8]) == 3
    assert sorted(by[None], key=str) == [(None, 0), (None, 36)]
    assert by[9] == [(9, 1)]
    assert joined(none).count() == 0
    assert op12(odd).columns == ["doc_id", "n_shingles", "component_id"]
    nulls = odd.sparkSession.createDataFrame([(None, "a b"), (3, "a B"), (None, "x y"), (None, "X y")], COLUMNS.split(", lang")[0])
    found = sorted(str((r["doc_id"], r["component_id"])) for r in op12(nulls).collect())
    assert found == ["(3, 3)", "(None, 3)", "(None, None)", "(None, None)"]
