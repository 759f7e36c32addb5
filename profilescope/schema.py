"""Table contracts: schemas, keys and the order in which hits are presented."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
LONGS = T.ArrayType(T.LongType())
ROLE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("experience", T.StringType())]
)
SALARY = T.StructType(
    [
        T.StructField("minimum", T.LongType()),
        T.StructField("currency", T.StringType()),
        T.StructField("city", T.StringType()),
    ]
)

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("desired_work_roles", STRINGS),
        T.StructField("desired_work_roles_experience", STRINGS),
        T.StructField("desired_roles", T.ArrayType(ROLE)),
        T.StructField("professional_experience", T.StringType()),
        T.StructField("work_locations", STRINGS),
        T.StructField("current_location", T.StringType()),
        T.StructField("work_authorization", T.StringType()),
        T.StructField("skills", STRINGS),
        T.StructField("summary", T.StringType()),
        T.StructField("headline", T.StringType()),
        T.StructField("contacted_company_ids", LONGS),
        T.StructField("batch_starts_at", T.TimestampType()),
        T.StructField("batch_ends_at", T.TimestampType()),
        T.StructField("added_to_batch_at", T.TimestampType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("blocked_companies", LONGS),
        T.StructField("work_experiences", STRINGS),
        T.StructField("avatar_url", T.StringType()),
        T.StructField("salary_expectations", T.ArrayType(SALARY)),
        T.StructField("latest_position", T.StringType()),
        T.StructField("languages", STRINGS),
        T.StructField("educations", STRINGS),
    ]
)

SCORE_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("person_id", T.StringType()),
        T.StructField("company_id", T.StringType()),
        T.StructField("position_id", T.StringType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("talent_id", T.LongType()),
        T.StructField("score", T.FloatType()),
    ]
)

# Text fields that keywords search, each with the boost of its whole-text form.
TEXT_FIELDS = {
    "skills": 2.0,
    "summary": 2.0,
    "headline": 2.0,
    "desired_work_roles": 1.0,
    "work_experiences": 1.0,
    "educations": 1.0,
}
WORD_BOOST = 2.0
ARRAY_TEXT_FIELDS = ("skills", "desired_work_roles", "work_experiences", "educations")


@dataclass(frozen=True)
class TableSpec:
    """What a table type must state to be ingested, searched, deleted from and reset.

    ``decode`` turns raw JSON text rows into typed rows, ``predicate`` turns a request into a
    filter Column, ``order`` lists the sort of a result. A type whose results need more than a filter and a sort (scores,
    pages) gives ``find``, from the table and the request to the result. ``inspect`` decodes like ``decode``, but tells a
    ``_reason`` beside bad rows instead of failing. New table types are plain instances.
    """

    name: str
    schema: T.StructType
    key: str
    decode: Callable[[DataFrame], DataFrame]
    predicate: Callable[..., Column] = lambda *_: F.lit(True)
    order: tuple[Column, ...] = field(default_factory=tuple)
    find: Callable[..., DataFrame] | None = None
    inspect: Callable[[DataFrame], DataFrame] | None = None

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)

    def search(self, table: DataFrame, *request: object) -> DataFrame:
        if self.find is not None:
            return self.find(table, *request)
        hits = table.where(self.predicate(*request))
        return hits.orderBy(*self.order) if self.order else hits

    def delete(self, table: DataFrame, keys: DataFrame) -> DataFrame:
        return table.join(keys.select(self.key).distinct(), self.key, "left_anti")
