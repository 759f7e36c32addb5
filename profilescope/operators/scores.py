"""Score lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilescope.functions.predicates import all_of

DEFAULT_SIZE = 10


def score_filter(job_id: int | None = None, talent_id: int | None = None) -> Column:
    wanted = {"job_id": job_id, "talent_id": talent_id}
    return all_of([F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None])


def search_scores(
    scores: DataFrame, job_id: int | None = None, talent_id: int | None = None, size: int = DEFAULT_SIZE
) -> DataFrame:
    """The first scores by ``request_id``."""
    return scores.where(score_filter(job_id, talent_id)).orderBy("request_id").limit(size)


def total_scores(scores: DataFrame, job_id: int | None = None, talent_id: int | None = None) -> DataFrame:
    return scores.where(score_filter(job_id, talent_id)).agg(F.count(F.lit(1)).alias("total"))
