"""Streaming ingest: decoded changes go to a table's change log, one batch per micro-batch.

A micro-batch is named by its query's id and its number, so streams collide neither with each other nor with
batch writers, and a replayed one is published once. Order comes from the sequence inside the data: late and
duplicate changes lose to newer ones, and to tombstones, whenever they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from profilescope.operators.changelog import OP, SEQUENCE, UPSERT
from profilescope.operators.joins import written_once
from profilescope.sources.documents import REASON, split_files
from profilescope.sources.tables import POSITION, StoredTable


def start_ingest(changes: DataFrame, table: StoredTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Run a stream of typed changes (with ``_seq`` and ``_op``) into a stored table.

    The default trigger takes in all that is available and stops. The query's id lives in the checkpoint folder; a
    stream with a new folder is a new writer.
    """
    missing = {SEQUENCE, OP, *table.spec.schema.fieldNames()} - set(changes.columns)
    if missing:
        raise ValueError(f"stream lacks columns: {sorted(missing)}")

    def publish(batch: DataFrame, number: int) -> None:
        table.write_changes(batch, number, writer=_writer(batch))

    return _started(changes, publish, checkpoint, trigger)


def _writer(batch: DataFrame) -> str:
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise RuntimeError("the micro-batch does not tell its query's id")
    return f"stream-{query}"


def _started(rows: DataFrame, publish, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_files(table: StoredTable, source: str, **options) -> DataFrame:
    """A stream of the whole text files under a folder, each a row ``value`` with its path ``file``."""
    files = table.spark.readStream.options(**options).text(source, wholetext=True)
    return files.select("value", F.col("_metadata.file_path").alias("file"))


def start_document_ingest(files: DataFrame, table: StoredTable, quarantine: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run a stream of files (``value``, ``file``) of raw JSON documents into a stored table.

    A file is taken whole or not at all. Good files are upserted with their micro-batch's number as sequence;
    of equal keys in it the later place in a file counts. A file with any bad document goes to the ``quarantine`` table instead, as one row (file, documents,
    place and reason of the first bad one). Each file ends up in one of both, once: the change log knows a micro-batch
    that is replayed, and its quarantine folder is written anew.
    """
    if table.spec.inspect is None:
        raise ValueError(f"table type {table.spec.name} cannot inspect documents")

    def publish(batch: DataFrame, number: int) -> None:
        documents = split_files(batch).withColumnRenamed("place", POSITION)
        inspected = written_once(table.spec.inspect(documents), "inspected")
        first_bad = F.min(F.when(F.col(REASON).isNotNull(), F.struct(F.col(POSITION).alias("place"), F.col(REASON).alias("reason"))))
        judged = inspected.groupBy("file").agg(F.count(F.lit(1)).alias("documents"), first_bad.alias("bad"))
        bad = written_once(judged.where("bad IS NOT NULL").select("file", "documents", "bad.place", "bad.reason"), "rejected")
        if not bad.isEmpty():
            bad.write.mode("overwrite").parquet(f"{quarantine}/batch={_writer(batch)}-{number}")
        good = inspected.join(bad.select("file"), "file", "left_anti")
        changes = good.withColumns({SEQUENCE: F.lit(number).cast("long"), OP: F.lit(UPSERT)})
        table.write_changes(changes, number, writer=_writer(batch))

    return _started(files, publish, checkpoint, trigger)
