"""From raw documents to training sequences, in five stages.

Each stage takes what its predecessor kept, as a Parquet table, and all but the last return the columns of
``documents``: quality rating rejects toxic and poor texts, of each group of near copies one document stays,
documents that hold a benchmark item go, secrets in the rest are replaced by a mark, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilescope.llm.common import table, written_once
from profilescope.llm.decontamination import without_leaks
from profilescope.llm.neardup import without_near_duplicates
from profilescope.llm.packing import pack
from profilescope.llm.quality import keep_good
from profilescope.llm.secrets import redact

#: Parts that a worker caches for packing: workers outlive their stage, and this memory then lies beside that of the next.
CACHED_PARTS = 120_000


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return keep_good(docs, table(spark, folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return without_leaks(docs, table(spark, folder, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row per piece of a sequence; the little-endian token ids are spelled in hexadecimal digits."""
    return pack(docs, cached_parts=CACHED_PARTS).withColumn("ids", F.hex("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: A trained model, a tokenizer and a randomness battery cannot be told in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The packed sequences of ``documents``; every stage is written to the shared folder and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = written_once(stage(spark, docs, folder), name)
    return docs
