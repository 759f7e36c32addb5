"""Work that is done once, where it was done per request, per reader or per value before."""

import contextlib
import io

from profilescope.functions import text
from profilescope.functions.keywords import SUBSTRING, WORD, analyse_keywords
from profilescope.operators.fulltext import folded_fields, may_hold
from profilescope.operators.highlight import highlights
from profilescope.operators.postings import judge_keywords, keyword_classes
from profilescope.operators.search import all_hits, matches
from profilescope.plans.requests import SearchRequest, decode_requests
from profilescope.schema import PROFILE_SCHEMA, TEXT_FIELDS
from profilescope.sources.documents import decode_profiles

TEXTS = {"skills": ["red widget", "blue anvil.js"], "summary": "A widget, the Widget; wid-get", "headline": "Nothing here"}


def people(spark):
    rows = [{"id": i, "accepted": True, "educations": [], "desired_work_roles": [], "work_experiences": [], **TEXTS} for i in (1, 2)]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def plan(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain(True)
    return out.getvalue()


def test_requests_with_the_same_keywords_are_judged_once(spark):
    raw = [(1, "widget"), (2, "widget"), (3, "anvil"), (4, None), (5, "widget")]
    saved = spark.createDataFrame([(i, {"keywords": k} if k else {}) for i, k in raw], "request_id long, params map<string,string>")
    requests = decode_requests(saved)
    classes, members = keyword_classes(requests)
    assert classes.count() == 2
    assert sorted(r["request_id"] for r in members.collect()) == [1, 2, 3, 5]
    judged = judge_keywords(requests, people(spark)).collect()
    scores = {(r["request_id"], r["id"]): r["score"] for r in judged}
    assert sorted(scores) == [(r, i) for r in (1, 2, 3, 5) for i in (1, 2)]
    assert scores[1, 1] == scores[2, 1] == scores[5, 2] != scores[3, 1]


def test_a_minimum_score_does_not_score_again(spark):
    def counted(**more):
        found, _ = matches(people(spark), SearchRequest(as_of="2017-03-01T00:00:00Z", keywords="widget", **more))
        return plan(found.select("id", "score")).split("== Optimized Logical Plan ==")[1].split("== Physical")[0].count("regexp_count")

    assert counted(min_score=0.1) == counted()


def test_hits_are_dealt_out_before_their_sort_samples_them(spark):
    hits = all_hits(people(spark), SearchRequest(as_of="2017-03-01T00:00:00Z", keywords="widget"))
    assert "RepartitionByExpression" in plan(hits.select("id", "score"))


def test_only_values_that_may_hold_a_word_are_folded(spark):
    rows = people(spark).limit(1)
    tokens = ["anvil"]
    skills, summary, headline = rows.selectExpr(f"{folded_fields(WORD, rows.columns, tokens)} AS f").first()["f"][:3]
    assert (skills, summary, headline) == ("\t\nblue\nanvil\n", "", "")
    assert may_hold("x", SUBSTRING, tokens) == may_hold("x", WORD, ["straße"]) == "true"
    phrase = rows.selectExpr(may_hold("summary", WORD, ["widget\n \nwidget"]), may_hold("summary", WORD, ["widget\nanvil"])).first()
    assert tuple(phrase) == (True, False)
    assert len(folded_fields(SUBSTRING, rows.columns, tokens)) and len(TEXT_FIELDS) == 6


def test_only_values_that_may_hold_a_word_are_highlighted(spark):
    query = analyse_keywords(spark, "widget", True)
    assert "filter(field.items" in highlights(query)
    shown = people(spark).limit(1).selectExpr(f"{highlights(query)} AS h").first()["h"]
    assert shown == {"skills.keyword": [" widget"], "summary.keyword": [" widget", " Widget"]}


def test_distinct_words_are_split_once(spark):
    rows = spark.createDataFrame([("Foo-bar's foo x1 foo-bar's",), ("foo X1 -",), (None,)], "t string")
    counted = {r["token"]: r["n"] for r in text.substring_token_counts(rows, "t").collect()}
    plain = rows.selectExpr(f"explode({text.substring_tokens('t')}) AS token").groupBy("token").count().collect()
    assert counted == {r["token"]: r["count"] for r in plain}


def test_salary_texts_are_parsed_once(spark):
    lines = spark.createDataFrame([("{}",)], "value string")
    shown = plan(decode_profiles(lines).select("salary_expectations")).split("== Optimized Logical Plan ==")[1].split("== Physical")[0]
    assert shown.count("parse_json(") <= 2 and shown.count("parse_json(") > 0 or shown.count("parseJson") <= 2


def test_words_with_marks_are_the_same_from_their_first_letter(spark):
    value = "plain ab-cd' -x x- 'y'z äö+ü word1.2 end."
    old = text.PUNCTUATED_WORD.replace(f"(?<!{text.NOT_WHITESPACE})", "", 1)
    row = spark.sql(f"SELECT {text.extract_all(text.literal(value), text.PUNCTUATED_WORD)} AS a, {text.extract_all(text.literal(value), old)} AS b").first()
    assert row["a"] == row["b"] and "plain" not in row["a"] and old != text.PUNCTUATED_WORD


def test_profiles_move_neither_texts_nor_line_items_for_small_tables(spark, tmp_path):
    """Texts are joined last, and suppliers meet the line items before their nations, whose join looks large to the planner."""
    import contextlib
    import io

    from profilescope.plans import binding

    rows = {
        "documents": spark.range(40).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang"),
        "nation": spark.range(25).selectExpr("id AS n_nationkey", "concat('NATION_', id) AS n_name"),
        "supplier": spark.range(300).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey"),
        "part": spark.range(20).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "'PROMO' AS p_type", "'B' AS p_brand"),
        "customer": spark.range(60).selectExpr(
            "id AS c_custkey", "1.0D AS c_acctbal", "'AUTO' AS c_mktsegment", "id % 25 AS c_nationkey"
        ),
        "orders": spark.range(120).selectExpr(
            "id AS o_orderkey", "id % 60 AS o_custkey", "'1-URGENT' AS o_orderpriority", "'F' AS o_orderstatus",
            "timestamp '1995-01-01' AS o_orderdate", "10.5D AS o_totalprice",
        ),
        "lineitem": spark.range(360).selectExpr(
            "id % 120 AS l_orderkey", "id % 20 AS l_partkey", "id % 300 AS l_suppkey", "1 AS l_linenumber", "'A' AS l_returnflag"
        ),
    }
    for name, table in rows.items():
        table.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    def exchanges(frame):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            frame.explain("formatted")
        return [part for part in out.getvalue().split("\n\n") if ") Exchange" in part.split("\n")[0] and "Input" in part]

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    try:
        spark.conf.set(threshold, "-1")
        moved = exchanges(binding.profiles(spark, str(tmp_path)))
        assert sum("summary#" in part for part in moved) == 1, moved
        spark.conf.set(threshold, "20000")
        assert not any("l_suppkey" in part for part in exchanges(binding.profiles(spark, str(tmp_path))))
    finally:
        spark.conf.set(threshold, before)
    person = binding.profiles(spark, str(tmp_path)).where("id = 7").first()
    assert person["summary"] == "text 7" and person["desired_work_roles_experience"] == ["4..6"]
    assert person["work_locations"] == sorted({f"NATION_{i % 300 % 25}" for i in range(360) if i % 120 % 60 == 7})
