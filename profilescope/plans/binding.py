"""Profiles, scores and saved searches derived from the star-schema tables.

Groups are combined before they are shuffled, and every array of a profile has a bounded domain (part
names, nations, priorities), so a customer with a third of all orders costs no more than another.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilescope.operators.changelog import DELETE, OP, SEQUENCE, UPSERT

AS_OF = "1995-06-01T00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def experience_bucket(count: str) -> str:
    return (
        f"CASE WHEN {count} <= 1 THEN '0..1' WHEN {count} <= 2 THEN '1..2' WHEN {count} <= 4 THEN '2..4' "
        f"WHEN {count} <= 6 THEN '4..6' WHEN {count} <= 8 THEN '6..8' ELSE '8+' END"
    )


def _order_facts(orders: DataFrame) -> DataFrame:
    """Batch dates, order count and salary expectations (one per priority) of each customer."""
    per_priority = orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.min("o_orderdate").alias("starts"),
        F.max("o_orderdate").alias("ends"),
        F.min(F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderdate END")).alias("added"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.expr("CASE WHEN o_orderstatus <> 'P' THEN cast(floor(o_totalprice) AS bigint) END")).alias("low"),
    )
    salary = F.struct(
        F.col("o_orderpriority").alias("city"), F.col("low").alias("minimum"), F.lit("EUR").alias("currency")
    )
    return (
        per_priority.groupBy("o_custkey")
        .agg(
            F.min("starts").alias("batch_starts_at"),
            F.max("ends").alias("batch_ends_at"),
            F.min("added").alias("added_to_batch_at"),
            F.sum("n").alias("order_count"),
            F.sort_array(F.collect_list(salary)).alias("salaries"),
        )
        .withColumnRenamed("o_custkey", "id")
    )


def _purchase_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Skills, roles, locations, brands and companies of each customer, from all its line items."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    bought = (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumns({"company": F.col("s_nationkey").cast("bigint"), "place": F.col("n_name")})
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    per_role = bought.groupBy("o_custkey", "p_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set("p_name").alias("names"),
        F.collect_set("p_brand").alias("brands"),
        F.collect_set("place").alias("places"),
        F.collect_set(F.expr("CASE WHEN l_linenumber = 1 AND l_returnflag = 'A' THEN company END")).alias("met"),
        F.collect_set(F.expr("CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN company END")).alias("barred"),
        F.max(F.expr("struct(o_orderdate, o_orderkey, -l_linenumber AS line)")).alias("last"),
    )
    role = F.expr(f"struct(p_type AS role, {experience_bucket('n')} AS experience)")

    def merged(column: str):
        return F.sort_array(F.array_distinct(F.flatten(F.collect_list(column))))

    return (
        per_role.groupBy("o_custkey")
        .agg(
            F.sort_array(F.collect_list(role)).alias("desired_roles"),
            merged("names").alias("skills"),
            merged("brands").alias("work_experiences"),
            merged("places").alias("work_locations"),
            merged("met").alias("contacted_company_ids"),
            merged("barred").alias("blocked_companies"),
            F.max(F.struct("last", "p_type"))["p_type"].alias("latest_position"),
        )
        .withColumnRenamed("o_custkey", "id")
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The profile table. Joins whose columns a query does not read are dropped by the optimizer."""
    documents = table(spark, folder, "documents")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    languages = documents.groupBy((F.col("doc_id") % 25).alias("place")).agg(
        F.sort_array(F.collect_set("lang")).alias("languages")
    )
    texts = documents.select("doc_id", F.col("text").alias("summary"))
    people = table(spark, folder, "customer").withColumn(
        "doc", F.col("c_custkey") % documents.agg(F.count(F.lit(1))).scalar()
    )
    joined = (
        people.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(languages, F.col("c_nationkey") == F.col("place"), "left")
        .withColumnRenamed("c_custkey", "id")
        .join(_order_facts(table(spark, folder, "orders")), "id", "left")
        .join(_purchase_facts(spark, folder), "id", "left")
        # Last, so that no other join moves the texts.
        .join(texts, F.col("doc") == F.col("doc_id"), "left")
    )

    def listed(name: str, kind: str = "string") -> str:
        return f"coalesce({name}, cast(array() AS array<{kind}>)) AS {name}"

    roles = "coalesce(desired_roles, cast(array() AS array<struct<role:string,experience:string>>))"
    salaries = (
        "transform(coalesce(salaries, array()), s -> struct(s.minimum AS minimum, s.currency AS currency, "
        "s.city AS city)) AS salary_expectations"
    )
    return joined.selectExpr(
        "id",
        "c_acctbal >= 0 AS accepted",
        f"transform({roles}, r -> r.role) AS desired_work_roles",
        f"transform({roles}, r -> r.experience) AS desired_work_roles_experience",
        f"{roles} AS desired_roles",
        f"{experience_bucket('coalesce(order_count, 0)')} AS professional_experience",
        listed("work_locations"),
        "n_name AS current_location",
        "element_at(array('yes', 'no', 'unsure'), cast(id % 3 AS int) + 1) AS work_authorization",
        listed("skills"),
        "coalesce(summary, '') AS summary",
        "concat(c_mktsegment, ' buyer from ', n_name) AS headline",
        listed("contacted_company_ids", "bigint"),
        "batch_starts_at",
        "batch_ends_at",
        "added_to_batch_at",
        "c_nationkey - 12 AS weight",
        listed("blocked_companies", "bigint"),
        listed("work_experiences"),
        "concat('https://images.example/', id, '.png') AS avatar_url",
        salaries,
        "coalesce(latest_position, '') AS latest_position",
        "filter(coalesce(languages, cast(array() AS array<string>)), (tongue, i) -> (id + i + 1) % 3 <> 0) AS languages",
        "array(c_mktsegment) AS educations",
    )


def scores(events: DataFrame) -> DataFrame:
    """One score per event; an optional id is missing for every third."""
    return events.selectExpr(
        "cast(event_id AS string) AS request_id",
        "CASE WHEN event_id % 3 <> 0 THEN event_type END AS person_id",
        "cast(NULL AS string) AS company_id",
        "cast(NULL AS string) AS position_id",
        "event_id % 10 AS job_id",
        "user_id AS talent_id",
        "cast(value AS float) AS score",
    )


def score_changes(events: DataFrame) -> DataFrame:
    """The events as a change log of scores with few keys; an error is a deletion."""
    return events.selectExpr(
        "concat_ws('-', user_id, event_id % 10) AS request_id",
        "event_type AS person_id",
        "cast(NULL AS string) AS company_id",
        "cast(NULL AS string) AS position_id",
        "event_id % 10 AS job_id",
        "user_id AS talent_id",
        "cast(value AS float) AS score",
        f"event_id AS {SEQUENCE}",
        f"CASE WHEN event_type = 'error' THEN '{DELETE}' ELSE '{UPSERT}' END AS {OP}",
    )


REQUEST_PARAMS = {
    "as_of": "concat(1995 + k % 5, '-06-01T00:00:00')",
    "epoch": "CASE WHEN k % 8 = 5 THEN concat('1995-01-', lpad(cast(1 + k % 28 AS string), 2, '0')) END",
    "work_locations": "CASE WHEN k % 8 = 0 THEN to_json(array(concat('NATION_', n), concat('NATION_', (n + 7) % 25), '2-HIGH')) END",
    "maximum_salary": "CASE WHEN k % 8 = 0 THEN cast(20000 + 100 * k AS string) END",
    "languages": "CASE WHEN k % 8 = 1 THEN '[\"en\", \"fr\"]' END",
    "company_id": "CASE WHEN k % 8 = 1 THEN cast(n AS string) END",
    "desired_work_roles": "CASE WHEN k % 8 = 2 THEN '[\"PROMO:5\", \" SMALL \"]' END",
    "current_location": "CASE WHEN k % 8 = 3 THEN to_json(array(concat('NATION_', n))) END",
    "contacted_talents": "CASE WHEN k % 8 = 4 THEN concat(k, ', ', k + 1, ',x') END",
    "presented_talents": "CASE WHEN k % 8 IN (4, 5) THEN to_json(array(2 * k + 1, 3 * k)) END",
    "work_authorization": "CASE WHEN k % 8 = 5 THEN '[\"yes\", \"no\"]' END",
    "bookmarked_talents": "CASE WHEN k % 8 = 6 THEN array_join(transform(sequence(1, 9), i -> i * k), ',') END",
    "professional_experience": "CASE WHEN k % 8 = 7 THEN '[\"8+\", \"4..6\"]' END",
    "ignored_talents": "CASE WHEN k % 8 = 7 THEN to_json(array(k, k + 2)) END",
    "keywords": (
        "CASE k % 7 WHEN 2 THEN name WHEN 3 THEN concat('\"', name, '\"') WHEN 4 THEN substr(noun, 2, 3) "
        "WHEN 5 THEN concat(adjective, ' AND NOT ', noun) WHEN 6 THEN 'NOT automobile' END"
    ),
    "features": (
        "CASE WHEN k % 7 = 2 AND k % 3 = 0 THEN '[\"no_fulltext_search\", \"keywords_should\"]' "
        "WHEN k % 7 IN (2, 5, 6) THEN '[\"no_fulltext_search\"]' "
        "WHEN k % 7 = 4 AND k % 3 = 0 THEN '[\"keywords_should\"]' END"
    ),
    "offset": "cast(k % 3 AS string)",
    "per_page": "CASE WHEN k % 2 = 0 THEN '5' END",
}


def raw_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One saved search per supplier, as raw parameters; its keywords are the last name of its share of all parts."""
    suppliers = table(spark, folder, "supplier")
    shares = suppliers.agg(F.count(F.lit(1)))
    slot = (F.col("p_partkey") % shares.scalar()).alias("slot")
    names = table(spark, folder, "part").groupBy(slot).agg(F.max("p_name").alias("name"))
    sources = (
        suppliers.withColumn("slot", F.col("s_suppkey") % shares.scalar())
        .join(names, "slot")
        .selectExpr(
            "s_suppkey AS k", "s_nationkey AS n", "name", "split(name, ' ')[0] AS adjective", "split(name, ' ')[1] AS noun"
        )
    )
    entries = ", ".join(f"'{name}', {value}" for name, value in REQUEST_PARAMS.items())
    return sources.selectExpr("k AS request_id", f"map_filter(map({entries}), (name, value) -> value IS NOT NULL) AS params")
