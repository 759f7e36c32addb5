import json

from conftest import AS_OF, year
from test_search import FACETS, KEYWORDS, expected

from profilescope.operators import batch
from profilescope.operators.batch import match_saved_searches, only_pairs, pages, totals, with_highlights, without_pairs
from profilescope.operators.postings import match_keywords
from profilescope.operators.search import all_hits, search_profiles
from profilescope.plans.requests import SearchRequest, _as_text, decode_requests


def raw_requests(spark, many):
    rows = [
        (i, {k: _as_text(x) for k, x in {"as_of": AS_OF, **params}.items()}) for i, params in enumerate(many)
    ]
    return spark.createDataFrame(rows, "request_id long, params map<string,string>")


MIXED = [params for params, _ in FACETS] + [
    {"keywords": k, "features": f} for k, f, _ in KEYWORDS
] + [
    {"keywords": "Lua+", "work_locations": ["Tampere", "Graz"]},
    {"keywords": "maps patient", "company_id": "81"},
    {"keywords": "NOT patient", "desired_work_roles": ["Archivist", "Cartographer:9"]},
    {"keywords": "perl", "epoch": year(2030), "presented_talents": [32, 31]},
    {"keywords": '"old maps" perl', "features": ["no_fulltext_search"]},
    {"keywords": '"keeps mainframes"', "features": ["no_fulltext_search"]},
    {"keywords": '"wrote in a greenhouse" cobol', "features": ["no_fulltext_search"]},
    {"presented_talents": [32, 35], "languages": ["Welsh"]},
    {"as_of": "2025-01-01"}, {"as_of": "2024-05-06T07:08:09Z"}, {"as_of": "2012-05-06T07:08:09Z"},
    {"as_of": "2013-12-31"}, {"as_of": "2011-01-01", "presented_talents": [32]},
    {"as_of": "soon"}, {"epoch": "soon"}, {"epoch": "soon", "as_of": "2017-01-01", "presented_talents": [31]},
    {"as_of": "13/2017", "keywords": "perl"}, {"as_of": "soon", "epoch": year(2012)}, {"as_of": "", "keywords": "NOT patient"},
    {"index": "no_such_table"}, {"index": "profiles", "keywords": "perl"}, {"index": "", "languages": ["Welsh"]},
    {"index": "no_such_table", "keywords": "perl"}, {"keywords": "script solid lua+ \"maps\""}, {"keywords": "the and"},
]


def test_batch_equals_single_searches(spark, profiles):
    raw = raw_requests(spark, MIXED)
    requests = decode_requests(raw).cache()
    pairs = match_saved_searches(requests, profiles).cache()
    found = {}
    for r in pairs.collect():
        found.setdefault(r["request_id"], []).append((r["id"], r["score"]))
    placed = {}
    for r in sorted(pages(pairs, requests).collect(), key=lambda r: (r["request_id"], r["place"])):
        placed.setdefault(r["request_id"], []).append(r["id"])
    counted = {r["request_id"]: r["total"] for r in totals(pairs).collect()}
    for i, params in enumerate(MIXED):
        request = SearchRequest.from_params(spark, {"as_of": AS_OF, **params})
        hits = all_hits(profiles, request)
        rows = hits.collect()
        want = sorted((r["id"], round(r["score"], 9) if "score" in hits.columns else None) for r in rows)
        got = sorted((k, None if s is None else round(s, 9)) for k, s in found.get(i, []))
        assert got == want, params
        assert counted.get(i, 0) == len(rows), params
        start, size = request.offset, request.per_page
        assert placed.get(i, []) == [r["id"] for r in rows][start : start + size], params


def test_pages_with_highlights_equal_single_searches(spark, profiles):
    requests = decode_requests(raw_requests(spark, MIXED)).cache()
    page = pages(match_saved_searches(requests, profiles), requests)
    got = {}
    for r in with_highlights(page, requests, profiles, fragments=2).collect():
        got.setdefault(r["request_id"], {})[r["id"]] = r["highlight"]
    shown = 0
    for i, params in enumerate(MIXED):
        request = SearchRequest.from_params(spark, {"as_of": AS_OF, **params}, fragments=2)
        want = {r["id"]: r["highlight"] for r in search_profiles(profiles, request).collect()}
        assert got.get(i, {}) == want, params
        shown += sum(h is not None for h in want.values())
    assert shown > 20


def test_minimum_score_in_both_forms(spark, profiles):
    asked = [p for p in MIXED if "keywords" in p][:12] + [{}]
    requests = decode_requests(raw_requests(spark, asked)).cache()
    got = {}
    for r in match_saved_searches(requests, profiles, min_score=0.9).collect():
        got.setdefault(r["request_id"], set()).add(r["id"])
    for i, params in enumerate(asked):
        request = SearchRequest.from_params(spark, {"as_of": AS_OF, **params}, min_score=0.9)
        assert got.get(i, set()) == {r["id"] for r in all_hits(profiles, request).collect()}, params


def test_pair_tables(spark, profiles):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "request_id long, id long")
    other = spark.createDataFrame([(1, 2), (9, 9)], "request_id long, id long")
    key = lambda rows: sorted((r["request_id"], r["id"]) for r in rows.collect())
    assert key(only_pairs(pairs, other)) == [(1, 2)]
    assert key(without_pairs(pairs, other)) == [(1, 1), (2, 1)]


def test_no_keywords_at_all(spark, profiles):
    requests = decode_requests(raw_requests(spark, [{}, {"languages": ["Welsh"]}]))
    assert match_keywords(requests, profiles).count() == 0
    assert match_saved_searches(requests, profiles).count() == len(expected({})) + len(expected({"languages": ["Welsh"]}))


def test_deep_pages_are_cut_in_two_steps(spark, profiles, monkeypatch):
    many = [{"per_page": 2, "offset": 1}, {"per_page": 3}, {"languages": ["Welsh"], "offset": 2}]
    requests = decode_requests(raw_requests(spark, many))
    pairs = batch.match_facets(requests, profiles).selectExpr("*", "cast(NULL AS double) AS score").cache()
    want = sorted(map(tuple, pages(pairs, requests).collect()))
    assert [r[2] for r in want] == expected({})[1:3] + expected({})[:3] + expected({"languages": ["Welsh"]})[2:]
    monkeypatch.setattr(batch, "GROUP_LIMIT", 0)
    assert sorted(map(tuple, pages(pairs, requests).collect())) == want


def test_requests_for_another_table_find_nothing(spark, profiles):
    requests = decode_requests(raw_requests(spark, [{}, {"index": "people"}, {"index": "no_such_table"}]))
    found = match_saved_searches(requests, profiles, table="people").select("request_id").distinct().collect()
    assert sorted(r[0] for r in found) == [0, 1]


def test_windows_that_end_in_9999(spark, profiles):
    from pyspark.sql import functions as F

    endless = profiles.withColumn("batch_ends_at", F.lit("9999-12-31T00:00:00Z").cast(profiles.schema["batch_ends_at"].dataType))
    many = [{"as_of": f"{y}-06-01T00:00:00Z"} for y in (2011, 2012, 2016, 5000, 9999)]
    pairs = match_saved_searches(decode_requests(raw_requests(spark, many)), endless)
    counts = {r["request_id"]: r["total"] for r in totals(pairs).collect()}
    for i, params in enumerate(many):
        want = all_hits(endless, SearchRequest.from_params(spark, params)).count()
        assert counts.get(i, 0) == want, params
