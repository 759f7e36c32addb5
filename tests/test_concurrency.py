"""Stored tables under many writers at a time, and what compaction touches."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F
from test_tables import keys, scores

from profilescope.sources import commitlog
from profilescope.sources.commitlog import CommitLog, State
from profilescope.sources.documents import SCORES
from profilescope.sources.tables import StoredTable
from profilescope.streaming.ingest import start_ingest


def at_once(*jobs):
    """Run the jobs in threads that start together; raises what any of them raised."""
    start, failed = threading.Barrier(len(jobs)), []

    def run(job):
        try:
            start.wait()
            job()
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=run, args=(job,)) for job in jobs]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if failed:
        raise failed[0]


def test_a_number_goes_to_one_writer(spark, tmp_path):
    files = [CommitLog(spark, str(tmp_path)).files for _ in range(8)]
    made = []
    for number in range(12):
        at_once(*(lambda f=f, i=i: made.append((number, i)) if f.create(str(i), "log", f"{number}.json") else None for i, f in enumerate(files)))
    assert [n for n, _ in sorted(made)] == list(range(12))
    assert all(files[0].read("log", f"{n}.json") == str(i) for n, i in made)
    assert not [name for name, _ in files[0].names("log") if name.startswith(".") and not name.endswith(".crc")]


def test_other_file_systems_rename_without_overwriting(spark, tmp_path, monkeypatch):
    """The way of file systems without links, on this one."""
    files = CommitLog(spark, str(tmp_path)).files
    monkeypatch.setattr(files, "scheme", lambda uri: "far")
    assert files.create("one", "log", "0.json") and not files.create("two", "log", "0.json")
    assert files.read("log", "0.json") == "one"


def test_writers_beside_a_stream_and_compactions(spark, tmp_path):
    """Three writers with six batches each, a stream and a compaction, all at once: nothing fails, nothing is lost."""
    table, source = StoredTable(spark, SCORES, str(tmp_path / "scores"), buckets=4), str(tmp_path / "in")
    for i in range(4):
        scores(spark, (f"stream-{i}", 1, i)).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema

    def writer(name):
        for batch in range(6):
            assert table.write_changes(scores(spark, (f"{name}-{batch}", batch, batch), ("shared", batch, batch)), batch, writer=name)

    def stream():
        raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        assert start_ingest(raw, table, str(tmp_path / "progress")).awaitTermination(240)

    def compactions():
        for _ in range(4):
            table.compact()

    at_once(*(lambda n=n: writer(n) for n in "abc"), stream, compactions)
    want = sorted([f"{n}-{i}" for n in "abc" for i in range(6)] + [f"stream-{i}" for i in range(4)] + ["shared"])
    assert keys(table.read()) == want
    assert {r["score"] for r in table.read().where("request_id = 'shared'").collect()} == {5.0}
    state = table.state()
    assert {w: r for w, r in state.writers.items() if w in "abc"} == {w: [[0, 5]] for w in "abc"}
    table.compact()
    assert keys(table.read()) == want and not table.state().tail
    table.vacuum(abandoned=0)
    assert keys(table.read()) == want and not table.write_changes(scores(spark, ("x", 1, 1)), 3, writer="b")


def test_two_deletes_and_a_reset_at_once(spark, tmp_path):
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"), buckets=4)
    table.write_changes(scores(spark, *((f"k{i}", 1, i) for i in range(6))), 0)
    gone = lambda k: spark.createDataFrame([(k,)], "request_id string")
    at_once(lambda: table.delete(gone("k1"), 1, writer="one"), lambda: table.delete(gone("k2"), 1, writer="two"))
    assert keys(table.read()) == ["k0", "k3", "k4", "k5"]
    at_once(table.reset, table.compact)
    assert keys(table.read()) == []


def test_of_two_compactions_one_stands(spark, tmp_path, monkeypatch):
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"), buckets=2)
    table.write_changes(scores(spark, ("a", 1, 1), ("b", 1, 1)), 0)
    real = table.log.commit

    def late(entry, **more):
        monkeypatch.setattr(table.log, "commit", real)
        StoredTable(spark, SCORES, table.folder).compact()
        table.write_changes(scores(spark, ("c", 1, 1)), 1)
        return real(entry, **more)

    monkeypatch.setattr(table.log, "commit", late)
    table.compact()
    state = table.state()
    assert [c["batch"] for c in state.tail] == [1] and keys(table.read()) == ["a", "b", "c"]
    assert len(os.listdir(tmp_path / "scores" / "snapshots")) == 1


def test_the_same_batch_from_two_writers_at_once(spark, tmp_path):
    """A replay that overtakes its first try is published once."""
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"))
    new = []
    at_once(*(lambda: new.append(table.write_changes(scores(spark, ("a", 1, 1)), 0)) for _ in range(3)))
    assert sorted(new) == [False, False, True] and len(table.state().tail) == 1
    assert len(os.listdir(tmp_path / "scores" / "changes")) == 1


def folders(table):
    return {b: f for b, f in table.state().snapshot.items()}


def test_a_change_of_one_key_rewrites_one_bucket(spark, tmp_path):
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"), buckets=8)
    table.write_changes(scores(spark, *((f"k{i}", i, i) for i in range(300))), 0)
    table.compact()
    before = folders(table)
    assert set(before) == set(range(8))
    table.write_changes(scores(spark, ("k7", 99, 900)), 1)
    assert len(table.state().tail[0]["buckets"]) == 1
    table.compact()
    after = folders(table)
    assert sum(after[b] != before[b] for b in before) == 1
    changed = next(b for b in before if after[b] != before[b])
    written = os.path.join(table.folder, after[changed])
    assert [n for n in os.listdir(written) if n.startswith("_bucket=")] == [f"_bucket={changed}"]
    rows = {r["request_id"]: r["score"] for r in table.read().collect()}
    assert len(rows) == 300 and rows["k7"] == 99.0 and rows["k8"] == 8.0


def test_compaction_reads_named_buckets_and_does_not_deal_them_out(spark, tmp_path):
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"), buckets=8)
    table.write_changes(scores(spark, *((f"k{i}", i, i) for i in range(300))), 0)
    table.compact()
    table.write_changes(scores(spark, ("k7", 99, 900)), 1)
    state = table.state()
    (bucket,) = state.tail[0]["buckets"]
    changed = table._changed(state, {bucket})
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert all("snapshots" not in f or f"_bucket={bucket}/" in f for f in changed.inputFiles())
    # Of the rows of the base only those that the tail names go through the exchange of the aggregate.
    whole = table._merged(state)
    assert sum("snapshots" in f for f in whole.inputFiles()) >= 8 and whole.count() == 300


def test_a_long_tail_is_dealt_out_once(spark, tmp_path, monkeypatch):
    from profilescope.sources import tables

    monkeypatch.setattr(tables, "BROADCAST_ROWS", 10)
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"), buckets=4)
    table.write_changes(scores(spark, *((f"k{i}", i, i) for i in range(60))), 0)
    table.compact()
    table.write_changes(scores(spark, *((f"k{i}", 1, 100 + i) for i in range(40, 80))), 1)
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert keys(table.read()) == sorted(f"k{i}" for i in range(80))


def test_checkpoints_and_trimmed_logs_tell_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commitlog, "CHECKPOINT_EVERY", 3)
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"), buckets=2)
    rng = random.Random(1)
    for batch in range(8):
        table.write_changes(scores(spark, (f"k{rng.randrange(4)}", batch, batch)), batch, writer=rng.choice("ab"))
        if batch == 4:
            table.compact()
    names = [n for n in os.listdir(tmp_path / "scores" / "log") if not n.startswith(".")]
    assert sum("checkpoint" in n for n in names) == 3
    replayed = State()
    for name in sorted(n for n in names if "checkpoint" not in n):
        replayed = replayed.after(json.loads((tmp_path / "scores" / "log" / name).read_text()))
    assert replayed == table.state()
    before = sorted(map(str, table.read().collect()))
    table.vacuum(abandoned=-60)
    assert len(os.listdir(tmp_path / "scores" / "log")) < len(names)
    assert sorted(map(str, table.read().collect())) == before


def test_a_dead_writers_folder_is_found(spark, tmp_path, monkeypatch):
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"), buckets=2)
    table.write_changes(scores(spark, ("a", 1, 1)), 0)

    def dies(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(table.log, "commit", dies)
        table.write_changes(scores(spark, ("b", 1, 1)), 1)
    assert len(os.listdir(tmp_path / "scores" / "changes")) == 2
    assert table.vacuum() == 0  # it may still be at work
    assert table.vacuum(abandoned=-60) == 1
    assert keys(table.read()) == ["a"] and table.write_changes(scores(spark, ("b", 1, 1)), 1)
    assert keys(table.read()) == ["a", "b"]


def test_equal_sequences_go_by_commit(spark, tmp_path):
    """Also after the batches went into a snapshot."""
    table = StoredTable(spark, SCORES, str(tmp_path / "scores"), buckets=2)
    for batch, score in enumerate((3, 1, 2)):
        table.write_changes(scores(spark, ("a", score, 7)), batch)
        if batch == 1:
            table.compact()
        assert [r["score"] for r in table.read().collect()] == [score]
    assert table.read().where(F.col("score") == 2).count() == 1
