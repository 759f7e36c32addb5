"""The stored keyword index: equal to one built anew after any changes, and read by the buckets asked for."""

import json
import random

import pytest
from conftest import AS_OF, DOCUMENTS
from pyspark.sql import functions as F
from test_batch import MIXED, raw_requests
from test_concurrency import at_once
from test_tables import lines

from profilescope.functions.keywords import EXACT, SUBSTRING, WORD
from profilescope.operators.batch import match_saved_searches
from profilescope.operators.postings import clause_tokens, used_modes
from profilescope.operators.relevance import term_statistics
from profilescope.operators.search import all_hits
from profilescope.plans.requests import SearchRequest, decode_requests
from profilescope.schema import ARRAY_TEXT_FIELDS, TEXT_FIELDS
from profilescope.sources import keyword_index
from profilescope.sources.documents import PROFILES
from profilescope.sources.keyword_index import KeywordIndex, document_postings
from profilescope.sources.tables import StoredTable

CHANGED = {"summary": "Wrote js, maps. Maps of re-acting Lua+", "skills": ["js", "Perl", "Perl"], "headline": "e'quay's"}


def stored(spark, path, buckets=4):
    table = StoredTable(spark, PROFILES, str(path / "profiles"), buckets=2)
    return table, KeywordIndex(table, buckets)


def publish(spark, table, batch, documents, sequence):
    table.index(lines(spark, *documents).withColumn("_seq", F.lit(sequence).cast("long")), batch)


def told(frame, *columns):
    places = F.transform(F.array_sort("places"), lambda p: F.concat_ws(":", p["item"], p["spot"]))
    rows = frame.withColumn("places", F.concat_ws(" ", F.array_sort(places)))
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows.select(*columns).collect())


POSTED = ["mode", "token", "id", "field", "freq", "norm", "places"]


def same_as_anew(index):
    profiles = index.table.read().cache()
    assert told(index._whole(index.manifest()), *POSTED) == told(document_postings(profiles), *POSTED)
    assert index.documents == profiles.count()
    counted = sorted(map(tuple, term_statistics(profiles).collect()))
    assert sorted(map(tuple, index.term_statistics().collect())) == counted
    assert sorted(map(str, index.read().collect())) == sorted(map(str, profiles.collect()))


def test_index_after_changes_equals_one_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "MANY_PARTS", 3)
    table, index = stored(spark, tmp_path)
    rng = random.Random(2)
    publish(spark, table, 0, DOCUMENTS, 10)
    assert index.refresh() == 0
    same_as_anew(index)
    for batch in range(1, 5):
        some = [{**d, **CHANGED, "latest_position": str(batch)} for d in rng.sample(DOCUMENTS, 2)]
        publish(spark, table, 2 * batch, some, rng.choice([5, 20 + batch]))
        if batch % 2:
            table.delete(spark.createDataFrame([(rng.choice(DOCUMENTS)["id"],)], "id long"), 2 * batch + 1, F.lit(21))
        if batch == 3:
            table.compact()
        index.refresh()
        same_as_anew(index)
    assert len(index.manifest()["parts"]) <= 3
    index.compact()
    assert len(index.manifest()["parts"]) == 1
    same_as_anew(index)


def test_a_refresh_makes_postings_of_changed_documents_only(spark, tmp_path):
    table, index = stored(spark, tmp_path)
    publish(spark, table, 0, DOCUMENTS, 1)
    index.refresh()
    number = index.manifest()["number"]
    assert index.refresh() == 0 and index.manifest()["number"] == number
    publish(spark, table, 1, [{**DOCUMENTS[0], **CHANGED}], 2)
    index.refresh()
    part = index.manifest()["parts"][-1]["folder"]
    ids = index._read(part, "postings", keyword_index.POSTING).select("id").distinct().collect()
    assert [r["id"] for r in ids] == [31]
    signed = {r["df"] for r in index._read(part, "statistics", "df long").collect()}
    assert signed == {-1, 1}


def test_reset_and_vacuum_build_anew(spark, tmp_path):
    table, index = stored(spark, tmp_path)
    publish(spark, table, 0, DOCUMENTS, 1)
    index.refresh()
    publish(spark, table, 1, [{**DOCUMENTS[1], **CHANGED}], 2)
    table.compact()
    table.vacuum()
    index.refresh()
    assert len(index.manifest()["parts"]) == 1
    same_as_anew(index)
    table.reset()
    index.refresh()
    assert index.documents == 0 and index.term_statistics().count() == 0
    publish(spark, table, 2, DOCUMENTS[:2], 1)
    index.refresh()
    same_as_anew(index)


def test_two_refreshes_at_once(spark, tmp_path):
    table, index = stored(spark, tmp_path)
    publish(spark, table, 0, DOCUMENTS[:3], 1)
    index.refresh()
    publish(spark, table, 1, DOCUMENTS[3:], 1)
    at_once(index.refresh, KeywordIndex(table).refresh)
    assert len(index.manifest()["parts"]) == 2
    same_as_anew(index)


def test_no_index_yet(spark, tmp_path):
    with pytest.raises(ValueError):
        stored(spark, tmp_path)[1].term_statistics()


def test_saved_searches_by_index_equal_those_by_texts(spark, tmp_path):
    table, index = stored(spark, tmp_path)
    publish(spark, table, 0, [{**d, **CHANGED} for d in DOCUMENTS], 1)
    index.refresh()
    publish(spark, table, 1, DOCUMENTS, 2)
    index.refresh()
    more = [{"keywords": k} for k in ("react", "ac", "e.g", "lua+", '"Solid.js"', "d4", "maps maps", "\\E q")]
    requests = decode_requests(raw_requests(spark, MIXED + more)).cache()
    profiles = index.read().cache()
    rows = lambda frame: sorted((r["request_id"], r["id"], None if r["score"] is None else round(r["score"], 8)) for r in frame.collect())
    assert rows(match_saved_searches(requests, profiles, index=index)) == rows(match_saved_searches(requests, profiles))


def test_asked_buckets_are_read_only(spark, tmp_path):
    table, index = stored(spark, tmp_path, buckets=64)
    publish(spark, table, 0, DOCUMENTS, 1)
    index.refresh()
    requests = decode_requests(raw_requests(spark, [{"keywords": "patient", "features": ["no_fulltext_search"]}]))
    tokens = clause_tokens(requests)
    found = index.postings(tokens, used_modes(requests))
    assert {r["id"] for r in found.collect()} == {31, 33}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tb" in plan or "PartitionFilters: [(tb" in plan
    whole = index._whole(index.manifest()).select("tb").distinct().count()
    asked = index._whole(index.manifest(), [keyword_index_bucket(spark, "patient")])
    assert asked.select("tb").distinct().count() == 1 < whole


def keyword_index_bucket(spark, token):
    return spark.range(1).select(keyword_index._bucket(F.lit(token), 64)).first()[0]


@pytest.mark.parametrize("keywords", ["patient maps", "perl", '"Lua+"', "solid"])
def test_a_search_with_stored_statistics_reads_texts_once(spark, tmp_path, keywords):
    table, index = stored(spark, tmp_path)
    publish(spark, table, 0, DOCUMENTS, 1)
    table.compact()
    index.refresh()
    features = [] if '"' in keywords else ["no_fulltext_search"]
    request = SearchRequest.from_params(spark, {"as_of": AS_OF, "keywords": keywords, "features": features})
    profiles = table.read()
    by_index, by_texts = all_hits(profiles, request, index), all_hits(profiles, request)
    assert [(r["id"], r["score"]) for r in by_index.collect()] == [(r["id"], r["score"]) for r in by_texts.collect()]
    tables = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [id#")
    assert tables(by_index) < tables(by_texts)


def test_documents_with_nothing_to_index(spark, tmp_path):
    table, index = stored(spark, tmp_path)
    empty = {"skills": [], "summary": "", "headline": " ", "work_experiences": [], "educations": [], "desired_work_roles": []}
    publish(spark, table, 0, [{**DOCUMENTS[1], **empty, "desired_roles": []}], 1)
    index.refresh()
    same_as_anew(index)
    assert json.loads(json.dumps(index.manifest()))["documents"] == 1
    assert {r["mode"] for r in index._whole(index.manifest()).collect()} <= {EXACT, SUBSTRING, WORD}


def test_words_of_a_text_are_counted_in_their_row(spark):
    """A posting moves once, and no word of a text is a row of its own that is aggregated."""
    words = "Maps, maps of the maps and js " * 3
    rows = spark.sql(f"SELECT id, '{words}' AS summary, array('Perl', 'Perl', '') AS skills FROM range(2)")
    others = {f: F.array().cast("array<string>") if f in ARRAY_TEXT_FIELDS else F.lit(None).cast("string") for f in TEXT_FIELDS}
    made = document_postings(rows.withColumns({f: c for f, c in others.items() if f not in ("summary", "skills")}))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
    found = {(r["mode"], r["token"], r["field"]): (r["freq"], len(r["places"])) for r in made.where("id = 1").collect()}
    assert found[SUBSTRING, "maps", "summary"] == (6, 0) and found[SUBSTRING, "maps,", "summary"] == (3, 0)
    assert found[WORD, "maps", "summary"] == (9, 9)
    assert found[EXACT, "Perl", "skills"] == (2, 0) and found[EXACT, "", "skills"] == (1, 0)
    assert made.count() == made.select("mode", "token", "id", "field").distinct().count()


def test_profiles_move_and_their_postings_do_not(spark, tmp_path):
    """Postings are many times as large as the profiles of which they are made, and so are grams and words."""
    table, index = stored(spark, tmp_path)
    publish(spark, table, 0, DOCUMENTS, 1)
    made = document_postings(table.read(), 16, 3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and made.rdd.getNumPartitions() == 3
    grams = keyword_index._dictionary(made, 16)._jdf.queryExecution().executedPlan().toString()
    assert grams.index("Generate") < grams.index("Exchange")
    assert told(made, *POSTED) == told(document_postings(table.read()), *POSTED)
    index.refresh()
    files = [f.name for kind in ("postings", "dictionary") for f in tmp_path.glob(f"**/index/parts/*/{kind}/*/*.parquet")]
    assert files and all(".zstd." in name for name in files)
