"""What several training-data operators share: scratch tables in the shared folder, words, row ids."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words of 64 bits in the bit table of :func:`probably_listed`: a broadcast of 1 MB, whatever it stands for.
FILTER_WORDS = 1 << 16
#: Rows of one partition are numbered below this.
ROWS_PER_PARTITION = 1 << 33


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent the master must be local (tests, a laptop): one machine shares its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="profilescope-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written_once(rows: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe from lost executors."""
    spark = rows.sparkSession
    path = os.path.join(scratch_folder(spark), f"{label}-{uuid.uuid4().hex}")
    rows.write.partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path) if partition_by else spark.read.schema(rows.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def row_numbers(count: int, start: int = 0) -> range:
    """Ids unique over all partitions for ``count`` rows of this task, after the first ``start``."""
    first = TaskContext.get().partitionId() * ROWS_PER_PARTITION + start
    return range(first, first + count)


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """The needed columns, with all others in a struct ``_others`` so that no name of theirs can clash; and the columns
    that bring back what ``docs`` has, in its order."""
    others = [c for c in docs.columns if c not in needed]
    aside = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("_others")] if others else []
    back = [F.col(c) if c in needed else F.col(f"_others.`{c}`") for c in docs.columns]
    return docs.select(*needed, *aside), back


def probably_listed(rows: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """Rows whose ``column`` is among the listed ids, and a few others, without moving the rows.

    A bit table of fixed size stands for the ids, so wide rows that a later join would drop need no shuffle. With
    very many ids it lets more rows through and the join that follows drops them.
    """

    def place(name: str) -> tuple[Column, Column]:
        spread = F.xxhash64(name)
        return F.pmod(spread, F.lit(FILTER_WORDS)).cast("int"), F.pmod(F.shiftrightunsigned(spread, 32), F.lit(64)).cast("int")

    word, bit = place(listed_column)
    one = F.expr("shiftleft(1L, _bit)")
    bits = listed.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(one).alias("_bits"))
    word, bit = place(column)
    return (
        rows.withColumns({"_word": word, "_bit": bit})
        .join(F.broadcast(bits), "_word")
        .where("shiftrightunsigned(_bits, _bit) & 1 = 1")
        .drop("_word", "_bit", "_bits")
    )
