"""The registered queries of the training-data operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from profilescope.llm import (
    collocations, decontamination, dialogues, language_model, neardup, packing, quality, secrets, sharding, spelling, topk,
    url_rules, vertical,
)
from profilescope.llm.common import table


def _over(run: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: run(*(table(spark, folder, name) for name in names))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_quality": _over(quality.op1, "documents", "labels"),
    "op2_association_rules": _over(url_rules.op2, "pages", "labels"),
    "op3_feistel_shards": _over(sharding.op3, "documents"),
    "op4_gated_recurrent": _over(language_model.op4, "documents"),
    "op5_randomness_battery": _over(secrets.op5, "documents"),
    "op6_no_random_access": _over(topk.op6, "embeddings"),
    "op7_fast_similarity_sketch": _over(neardup.op7, "documents"),
    "op8_block_max_wand": _over(decontamination.op8, "documents", "benchmark"),
    "op9_perspective_rotation": _over(dialogues.op9, "conversations"),
    "op10_sum_of_squares": _over(packing.op10, "documents"),
    "op11_setm_mining": _over(collocations.op11, "documents"),
    "op12_vertical_partitioning": _over(vertical.op12, "documents"),
    "op13_finite_state_composition": _over(spelling.op13, "documents"),
}

ORACLE: dict[str, str] = {
    "op6_no_random_access": topk.ORACLE_OP6,
    "op7_fast_similarity_sketch": neardup.ORACLE_OP7,
    "op9_perspective_rotation": dialogues.ORACLE_OP9,
    "op11_setm_mining": collocations.ORACLE_OP11,
    "op12_vertical_partitioning": vertical.ORACLE_OP12,
    "op13_finite_state_composition": spelling.ORACLE_OP13,
}
