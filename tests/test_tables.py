import json

import pytest
from conftest import AS_OF, DOCUMENTS, document
from test_search import expected
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from profilescope.operators.scores import search_scores, total_scores
from profilescope.operators.search import search_profiles
from profilescope.plans.requests import SearchRequest
from profilescope.sources.documents import PROFILES, SCORES, ingest_profiles, inspect_profiles, read_documents
from profilescope.sources.tables import StoredTable, reset_table
from profilescope.streaming.ingest import read_files, start_document_ingest, start_ingest


def lines(spark, *documents):
    return spark.createDataFrame([(json.dumps(d),) for d in documents], "value string")


def ids(frame):
    return [r["id"] for r in search_profiles(frame, SearchRequest(as_of=AS_OF)).collect()]


def test_decodes_salaries_and_defaults(spark):
    raw = document(
        71, 2014, 2014, 2,
        skills=["Perl"], summary="s", headline="h",
        desired_roles=[{"role": "Ship/Boat Builder", "experience": "1..2"}, {"role": "Dyer", "experience": "6..8"}],
        salary_expectations=[
            {"minimum": 18500, "maximum": 23000, "currency": "NOK", "city": "Bergen"},
            {"minimum": None, "currency": "NOK", "city": "Molde"},
            [21700, "NOK", "Hamar"],
        ],
    )
    del raw["desired_work_roles"], raw["desired_work_roles_experience"]
    row = ingest_profiles(lines(spark, raw)).first()
    assert row["desired_work_roles"] == ["Ship/Boat Builder", "Dyer"]
    assert row["desired_work_roles_experience"] == ["1..2", "6..8"]
    assert [tuple(s) for s in row["salary_expectations"]] == [
        (18500, "NOK", "Bergen"), (None, "NOK", "Molde"), (21700, "NOK", "Hamar"),
    ]


def test_roles_are_zipped_to_the_shorter(spark):
    raw = {**DOCUMENTS[2], "desired_work_roles": ["A", "B"], "desired_work_roles_experience": ["8+"]}
    row = ingest_profiles(lines(spark, raw)).first()
    assert [tuple(r) for r in row["desired_roles"]] == [("A", "8+")]
    assert row["desired_work_roles"] == ["A", "B"]


@pytest.mark.parametrize(
    "change",
    [
        {"headline": None}, {"headline": 5}, {"id": "13"}, {"id": -1}, {"accepted": "yes"},
        {"skills": ["a", None]}, {"skills": [1]}, {"weight": 1.5}, {"batch_ends_at": "soon"},
        {"salary_expectations": [[1, "EUR"]]}, {"contacted_company_ids": [-4]}, {"desired_roles": [{"role": "x"}]},
    ],
)
def test_bad_documents_reject_the_batch(spark, change):
    with pytest.raises((PySparkException, Py4JJavaError)):
        ingest_profiles(lines(spark, DOCUMENTS[1], {**DOCUMENTS[0], **change})).collect()


def test_missing_field_rejects_the_batch(spark):
    bad = {k: v for k, v in DOCUMENTS[0].items() if k != "languages"}
    with pytest.raises((PySparkException, Py4JJavaError)):
        ingest_profiles(lines(spark, bad)).collect()


def test_reads_lists_of_documents(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text(json.dumps(DOCUMENTS[:3]) + "\n" + json.dumps(DOCUMENTS[3]) + "\n")
    assert ingest_profiles(read_documents(spark, str(path))).count() == 4


def test_index_delete_compact_reset(spark, tmp_path):
    table = StoredTable(spark, PROFILES, str(tmp_path / "profiles"))
    assert table.read().count() == 0
    table.index(lines(spark, *DOCUMENTS), 0)
    everyone = expected({})
    assert ids(table.read()) == everyone
    table.delete(spark.createDataFrame([(31,), (34,)], "id long"), 1)
    left = [i for i in everyone if i not in (31, 34)]
    assert ids(table.read()) == left
    assert table.compact() == 1
    assert ids(table.read()) == left
    for batch in (2, 2):
        table.index(lines(spark, {**DOCUMENTS[2], "accepted": False}), batch)
        assert ids(table.read()) == [i for i in left if i != 33]
    table.reset(3)
    assert table.read().count() == 0
    table.index(lines(spark, DOCUMENTS[0]), 4)
    assert ids(table.read()) == [31]


def test_late_change_loses_after_compaction(spark, tmp_path):
    table = StoredTable(spark, PROFILES, str(tmp_path / "profiles"))
    new = lines(spark, {**DOCUMENTS[1], "headline": "new"}).withColumn("_seq", F.lit(9).cast("long"))
    old = lines(spark, {**DOCUMENTS[1], "headline": "old"}).withColumn("_seq", F.lit(4).cast("long"))
    table.index(new, 0)
    table.compact()
    table.index(old, 1)
    assert [r["headline"] for r in table.read().collect()] == ["new"]


def test_reset_plain_table(spark, profiles, tmp_path):
    path = str(tmp_path / "plain")
    profiles.write.parquet(path)
    reset_table(spark, PROFILES, path)
    again = spark.read.parquet(path)
    assert again.count() == 0 and again.columns == PROFILES.schema.fieldNames()


def test_scores(spark, tmp_path):
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"))
    full = {
        "request_id": "r7", "person_id": "p3", "company_id": "c2", "position_id": "o9",
        "job_id": 5, "talent_id": 12, "score": 0.8125,
    }
    table.index(lines(spark, full, {"request_id": "r8", "job_id": 5, "talent_id": 14, "score": 0.375}), 0)
    scores = table.read()
    assert total_scores(scores).first()["total"] == 2
    assert total_scores(scores, job_id=5).first()["total"] == 2
    assert [r["request_id"] for r in search_scores(scores, 5, 12).collect()] == ["r7"]
    table.delete(search_scores(scores, talent_id=12), 1)
    assert total_scores(table.read(), talent_id=12).first()["total"] == 0


def test_streaming_ingest(spark, tmp_path):
    source = str(tmp_path / "in")
    table = StoredTable(spark, PROFILES, str(tmp_path / "profiles"))

    def stream(name):
        raw = spark.readStream.schema("value string, _seq long, _op string").parquet(source)
        query = start_ingest(PROFILES.decode(raw), table, str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120)

    def publish(seq, op, *documents):
        rows = lines(spark, *documents).withColumns({"_seq": F.lit(seq).cast("long"), "_op": F.lit(op)})
        rows.coalesce(1).write.mode("append").parquet(source)

    publish(1, "upsert", *DOCUMENTS)
    stream("one")
    publish(3, "delete", DOCUMENTS[0])
    publish(2, "upsert", DOCUMENTS[0])
    stream("two")
    assert ids(table.read()) == [i for i in expected({}) if i != 31]


def keys(frame):
    return sorted(r["request_id"] for r in frame.collect())


def scores(spark, *rows):
    """(request_id, score, sequence) as typed upserts."""
    typed = spark.createDataFrame([(i, 1, 1, float(s), q) for i, s, q in rows], "request_id string, job_id long, talent_id long, score double, _seq long")
    nulls = {c: F.lit(None).cast("string") for c in ("person_id", "company_id", "position_id")}
    return typed.withColumns({**nulls, "score": F.col("score").cast(SCORES.schema["score"].dataType), "_op": F.lit("upsert")})


def test_streams_and_batches_do_not_collide(spark, tmp_path):
    """A stream counts its batches from 0 too: neither compaction nor a reset nor another stream hides or replaces it."""
    table, source = StoredTable(spark, SCORES, str(tmp_path / "scores")), str(tmp_path / "in")
    for i in range(3):
        table.write_changes(scores(spark, (f"k{i}", 1, i)), i)
    table.compact()

    def stream(checkpoint):
        raw = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        assert start_ingest(raw, table, str(tmp_path / checkpoint)).awaitTermination(120)

    scores(spark, ("s0", 1, 100)).write.parquet(source)
    stream("one")
    assert keys(table.read()) == ["k0", "k1", "k2", "s0"]
    stream("one")
    scores(spark, ("s1", 1, 101)).write.mode("append").parquet(source)
    stream("one")
    stream("two")
    assert keys(table.read()) == ["k0", "k1", "k2", "s0", "s1"]
    table.reset()
    assert keys(table.read()) == []
    scores(spark, ("s2", 1, 5)).write.mode("append").parquet(source)
    stream("one")
    assert keys(table.read()) == ["s2"]


def test_a_late_change_does_not_undo_a_compacted_delete(spark, tmp_path):
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"))
    table.write_changes(scores(spark, ("a", 1, 100), ("b", 1, 100)), 0)
    table.delete(spark.createDataFrame([("a",)], "request_id string"), 1, F.lit(200))
    table.compact()
    table.write_changes(scores(spark, ("a", 2, 150)), 2)
    assert keys(table.read()) == ["b"]
    table.compact()
    assert keys(table.read()) == ["b"]
    table.write_changes(scores(spark, ("a", 2, 201)), 3)
    assert keys(table.read()) == ["a", "b"]
    assert table.vacuum() == 4 and keys(table.read()) == ["a", "b"]


def test_delete_removes_what_is_there(spark, tmp_path):
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"))
    table.write_changes(scores(spark, ("a", 1, 10**9)), 0)
    table.delete(spark.createDataFrame([("a",), ("none",)], "request_id string"), 1)
    assert keys(table.read()) == []


def test_the_last_of_equal_sequences_counts(spark, tmp_path):
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"))
    rows = [json.dumps({"request_id": "a", "job_id": 1, "talent_id": 1, "score": i / 8}) for i in range(8)]
    for parts, batch in ((1, 0), (4, 1)):
        table.index(spark.createDataFrame([(r,) for r in rows], "value string").coalesce(parts), batch)
        assert [r["score"] for r in table.read().collect()] == [7 / 8]
    table.index(spark.createDataFrame([(rows[2],)], "value string").withColumn("_seq", F.lit(1).cast("long")), 2)
    assert [r["score"] for r in table.read().collect()] == [2 / 8]


def test_a_replayed_batch_is_published_once(spark, tmp_path):
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"))
    assert table.write_changes(scores(spark, ("a", 1, 0)), 0)
    assert not table.write_changes(scores(spark, ("b", 1, 0)), 0)
    assert table.write_changes(scores(spark, ("c", 1, 0)), 0, writer="other")
    assert keys(table.read()) == ["a", "c"]


def test_reads_leave_the_snapshot_where_it_is(spark, tmp_path):
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"))
    table.write_changes(scores(spark, *((f"k{i}", 1, i) for i in range(500))), 0)
    table.compact()
    table.write_changes(scores(spark, ("k7", 2, 900)), 1)
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert table.read().count() == 500


@pytest.mark.parametrize(
    "salary",
    [
        ["abc", "EUR", "Bonn"], {"minimum": "abc", "currency": "EUR", "city": "Bonn"}, [1.5, "EUR", "Bonn"], [-5, "EUR", "Bonn"],
        [1, 2, 3], [1, "EUR", "Bonn", "more"], {"minimum": 2**63, "currency": "EUR", "city": "Bonn"}, {"minimum": 1, "city": "Bonn"}, 7,
    ],
)
def test_bad_salaries_reject_the_batch(spark, salary):
    with pytest.raises((PySparkException, Py4JJavaError)):
        ingest_profiles(lines(spark, {**DOCUMENTS[0], "salary_expectations": [salary]})).collect()


BAD = [
    {"headline": None}, {"headline": 5}, {"id": "13"}, {"id": -1}, {"accepted": "yes"}, {"skills": ["a", None]}, {"skills": [1]},
    {"weight": 1.5}, {"batch_ends_at": "soon"}, {"contacted_company_ids": [-4]}, {"contacted_company_ids": [1, "x"]},
    {"desired_roles": [{"role": "x"}]}, {"desired_roles": [{"role": 5, "experience": "8+"}]}, {"salary_expectations": [7]},
    {"salary_expectations": [[1, 2, 3]]}, {"salary_expectations": [{"minimum": "abc", "currency": "EUR", "city": "Bonn"}]},
]


def test_inspection_tells_what_decoding_raises(spark):
    good = inspect_profiles(lines(spark, *DOCUMENTS))
    assert {r["_reason"] for r in good.collect()} == {None}
    assert sorted(map(str, good.drop("_reason").collect())) == sorted(map(str, ingest_profiles(lines(spark, *DOCUMENTS)).collect()))
    texts = [json.dumps({**DOCUMENTS[0], **bad}) for bad in BAD] + ["", "nonsense", "[1]", "null", "{", "{}"]
    rows = inspect_profiles(spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)).collect()
    assert [r["_reason"] for r in rows[: len(BAD)]] == [f"bad or missing field: {next(iter(bad))}" for bad in BAD]
    assert all(r["_reason"] for r in rows) and len(rows) == len(texts)


def test_streamed_files_are_taken_whole_or_rejected(spark, tmp_path):
    source, table = tmp_path / "in", StoredTable(spark, PROFILES, str(tmp_path / "profiles"))
    source.mkdir()
    one, two, three, four = (json.dumps(d) for d in DOCUMENTS[:4])
    bad = json.dumps({**DOCUMENTS[4], "weight": "heavy"})
    (source / "lines.json").write_text(f"{one}\n\n{two}\n")
    (source / "list.json").write_text(json.dumps(DOCUMENTS[2:3], indent=2))
    (source / "mixed.json").write_text(f"{four}\n{bad}\n{three}")
    (source / "empty.json").write_text("")
    (source / "broken.json").write_text("[{")
    quarantine = str(tmp_path / "quarantine")

    def stream(checkpoint="progress"):
        query = start_document_ingest(read_files(table, str(source)), table, quarantine, str(tmp_path / checkpoint))
        assert query.awaitTermination(120)

    def rejected():
        rows = spark.read.parquet(quarantine).collect()
        return sorted((r["file"].split("/")[-1], r["documents"], r["place"], r["reason"]) for r in rows)

    stream()
    assert sorted(r["id"] for r in table.read().collect()) == [31, 32, 33]
    want = [("broken.json", 1, 0, "no JSON object"), ("mixed.json", 3, 1, "bad or missing field: weight")]
    assert rejected() == want
    stream()  # nothing new
    (source / "later.json").write_text(json.dumps({**DOCUMENTS[0], "headline": "Later"}))
    stream()
    assert {r["id"]: r["headline"] for r in table.read().collect()}[31] == "Later" and rejected() == want


def test_tables_search_by_their_type(spark, tmp_path):
    table = StoredTable(spark, PROFILES, str(tmp_path / "profiles"))
    table.index(lines(spark, *DOCUMENTS), 0)
    request = SearchRequest(as_of=AS_OF, languages=("Welsh",))
    assert [r["id"] for r in table.search(request).collect()] == ids_of(table.read(), request)
    assert [r["id"] for r in PROFILES.search(table.read(), SearchRequest(as_of=AS_OF)).collect()] == expected({})
    assert table.search(SearchRequest(index="no_such_table")).count() == 0
    stored = StoredTable(spark, SCORES, str(tmp_path / "scores"))
    stored.write_changes(scores(spark, ("b", 1, 0), ("a", 2, 0)), 0)
    assert [r["request_id"] for r in stored.search(1, None).collect()] == ["a", "b"] and stored.search(2).count() == 0


def ids_of(frame, request):
    return [r["id"] for r in search_profiles(frame, request).collect()]


def test_role_names_are_text(spark):
    with pytest.raises((PySparkException, Py4JJavaError)):
        ingest_profiles(lines(spark, {**DOCUMENTS[0], "desired_roles": [{"role": 5, "experience": "8+"}]})).collect()
