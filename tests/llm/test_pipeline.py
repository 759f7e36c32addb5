"""The whole pipeline on planted documents, stage by stage."""

import random

import corpus_pipeline

from .conftest import words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_planted_documents(spark, tmp_path):
    rng, rows, labels = random.Random(9), [], []
    item = words(900, 30)
    for i in range(300):
        text = words(i, 60)
        if i % 10 == 1:
            text += " vile scum vile rotten scum"
        if i % 10 == 2:
            text = rows[i - 2][1]  # an exact copy of a clean one
        if i % 10 == 3:
            text = rows[i - 3][1] + " ende"
        if i % 10 == 4:
            text += " " + item
        if i % 10 == 5:
            text += ' password = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"'
        rows.append((i, text, "en", "s", len(text)))
        if i % 2 or i % 4 == 0:
            labels.append((i, 1, int(i % 10 == 1)))
    rows.append((None, None, None, None, None))
    folder = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = {i for i in range(300) if i % 10 in (0, 5, 6, 7, 8, 9)}
    rated = set(seen["quality"])
    assert not {i for i in rated if i is not None and i % 10 == 1}
    assert {i for i in range(300) if i % 10 != 1} <= rated
    assert {i for i in seen["near_duplicates"] if i is not None} == {i for i in range(300) if i % 10 not in (1, 2, 3)}
    assert {i for i in seen["decontamination"] if i is not None} == clean
    assert {i for i in seen["secrets"] if i is not None} == clean
    for i, r in seen["secrets"].items():
        if i is not None and i % 10 == 5:
            assert r["text"].endswith('[SECRET]"') and r["n_chars"] == len(r["text"])
        elif i is not None:
            assert r["text"] == rows[i][1]
    assert set(seen["packing"]) == set(seen["secrets"])
    run = corpus_pipeline.run(spark, folder)
    assert run.count() == docs.count() and run.columns == docs.columns


#: Columns that the operators of the stages add, and others they use inside.
NAMES = ["selected", "expected_grade", "first", "component_id", "n_shingles", "secrets", "spans", "_others", "_document", "_text", "key"]


def test_stages_keep_every_column(spark, tmp_path):
    """Whatever its name, and with empty, null and very long texts."""
    from pyspark.sql import functions as F

    folder = str(tmp_path)
    long_text = words(70, 200_000) + " " + "x" * 300_000
    rows = [(i, words(i, 40), "en", "s", 1) for i in range(30)] + [
        (30, None, None, None, None), (31, "", "en", "s", 0), (32, long_text, "en", "s", 9), (None, "a b c", "en", "s", 5),
    ]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name in NAMES:
        docs = docs.withColumn(name, F.concat(F.lit("my "), F.lit(name)))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, words(901, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        kept = out.collect()
        assert len(kept) >= 30 and all(r[c] == f"my {c}" for r in kept for c in NAMES), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in rows}


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
