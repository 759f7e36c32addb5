import json
import re

import pytest
from conftest import AS_OF, DOCUMENTS, year

from profilescope.operators.search import (
    all_hits,
    explain_search,
    search_profiles,
    search_results,
    select_table,
    to_json,
    total_hits,
)
from profilescope.plans.requests import SearchRequest


def search(spark, table, params, run=search_profiles):
    return run(table, SearchRequest.from_params(spark, {"as_of": AS_OF, **params}))


def ids(frame):
    return [r["id"] for r in frame.collect()]


RANGES = ["0..1", "1..2", "2..4", "4..6", "6..8", "8+"]


def role_list(d):
    given = d.get("desired_roles") or []
    return [(r["role"], r["experience"]) for r in given] or list(
        zip(d["desired_work_roles"], d["desired_work_roles_experience"], strict=False)
    )


def least(salary):
    return (salary["minimum"], salary["city"]) if isinstance(salary, dict) else (salary[0], salary[2])


def fits(d, p):
    """The definition of a facet search, told again on the raw documents."""
    if p.get("epoch"):
        window = d["batch_starts_at"] == p["epoch"]
    else:
        window = d["batch_starts_at"] <= AS_OF <= d["batch_ends_at"]
    if not ((d["accepted"] and window) or d["id"] in p.get("presented_talents", [])):
        return False
    if any(k in p and d[f] not in p[k] for k, f in (
        ("professional_experience", "professional_experience"), ("work_authorization", "work_authorization"),
        ("current_location", "current_location"),
    )):
        return False
    if "work_locations" in p and not set(p["work_locations"]) & set(d["work_locations"]):
        return False
    if not set(p.get("languages", [])) <= set(d["languages"]):
        return False
    if "bookmarked_talents" in p and d["id"] not in p["bookmarked_talents"]:
        return False
    if d["id"] in p.get("contacted_talents", []) or d["id"] in p.get("ignored_talents", []):
        return False
    company = int(p.get("company_id", -1))
    if company in d["contacted_company_ids"] or company in d["blocked_companies"]:
        return False
    if "maximum_salary" in p:
        cities = p.get("work_locations") or None
        if not any(
            m is not None and m <= int(p["maximum_salary"]) and (cities is None or city in cities)
            for m, city in map(least, d["salary_expectations"])
        ):
            return False
    if "desired_work_roles" in p:
        wanted = [(r.split(":")[0], int(r.split(":")[1]) if ":" in r else None) for r in p["desired_work_roles"]]
        first = {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 4, 8: 4}  # fixed values: the ladder of ranges
        if not any(
            role == name and (low is None or RANGES.index(have) >= first.get(low, 5))
            for role, have in role_list(d)
            for name, low in wanted
        ):
            return False
    return True


def expected(params):
    """Ids in business order: start, date of addition and weight, all descending, then id."""
    hits = [d for d in DOCUMENTS if fits(d, params)]
    hits.sort(key=lambda d: d["id"])
    for field in ("weight", "added_to_batch_at", "batch_starts_at"):
        hits.sort(key=lambda d, f=field: d[f], reverse=True)
    return [d["id"] for d in hits]


#: Requests that mean what they say.
PLAIN = [
    {}, {"epoch": year(2030)}, {"epoch": year(2012)}, {"epoch": year(2015)},
    {"desired_work_roles": ["Archivist"]}, {"desired_work_roles": ["Archivist:3"]}, {"desired_work_roles": ["Cartographer:5"]},
    {"desired_work_roles": ["Cartographer:7", "Archivist:1"]}, {"professional_experience": ["6..8"]},
    {"work_locations": ["Tampere"]}, {"work_locations": ["Tampere", "Porto"]}, {"current_location": ["Porto"]},
    {"work_authorization": ["granted", "none"]}, {"languages": ["Welsh"]}, {"languages": ["Welsh", "Finnish"]},
    {"company_id": "81"}, {"company_id": "82"}, {"bookmarked_talents": [31, 34, 32, 99]}, {"contacted_talents": [33]},
    {"ignored_talents": [31, 35]}, {"maximum_salary": "30000"}, {"maximum_salary": "40000", "work_locations": ["Graz"]},
    {"maximum_salary": "40000", "work_locations": ["Graz", "Tampere"]}, {"presented_talents": [32]},
    {"epoch": year(2030), "presented_talents": [32, 36]},
]
#: Other ways to say the same, or nothing.
FORMS = [
    ({"keywords": ""}, {}), ({"per_page": "many", "offset": "x"}, {}), ({"company_id": "none"}, {}),
    ({"bookmarked_talents": "31,34"}, {"bookmarked_talents": [31, 34]}),
    ({"bookmarked_talents": "31, 34"}, {"bookmarked_talents": [31, 34]}), ({"bookmarked_talents": "p, q"}, {}),
    ({"contacted_talents": "33,35"}, {"contacted_talents": [33, 35]}), ({"ignored_talents": "31, 33"}, {"ignored_talents": [31, 33]}),
    ({"maximum_salary": "plenty"}, {}), ({"epoch": year(2030), "presented_talents": "32"}, {"epoch": year(2030), "presented_talents": [32]}),
]
FACETS = [(p, expected(p)) for p in PLAIN] + [(p, expected(same)) for p, same in FORMS]
FACETS += [
    ({"per_page": 2, "offset": 1}, expected({})[1:3]), ({"per_page": "3", "offset": "2"}, expected({})[2:5]),
    ({"per_page": 2, "offset": 40}, []), ({"offset": 3_000_000_000}, []), ({"offset": 2**63 - 1}, []),
]


def texts(d):
    listed = d["skills"] + d["work_experiences"] + d["educations"] + [role for role, _ in role_list(d)]
    return [*listed, d["summary"], d["headline"]]


def part(d, term):
    """Whether a space-separated token, one of its alphanumeric parts, or these joined, contains the term."""
    for token in " ".join(texts(d)).lower().split():
        parts = re.findall("[a-z0-9]+", token)
        if any(term in x for x in (token, *parts, "".join(parts))):
            return True
    return False


def word(d, term):
    return term in re.findall("[a-z0-9]+", " ".join(texts(d)).lower())


W, S = "no_fulltext_search", "keywords_should"
MEANT = [
    ("Perl", [], lambda d: part(d, "perl")),
    ("Perl", [W], lambda d: word(d, "perl")),
    ("perlite", [W], lambda d: word(d, "perlite")),
    ("QGIS", [], lambda d: part(d, "qgis")),
    ("QGIS", [W], lambda d: word(d, "qgis")),
    ("maps", [W], lambda d: word(d, "maps")),
    ("map", [], lambda d: part(d, "map")),
    ("map", [W], lambda d: False),
    ("F#", [], lambda d: part(d, "f#")),
    ("Lua+ AND NOT F#", [], lambda d: part(d, "lua+") and not part(d, "f#")),
    ("+Lua+ -F#", [], lambda d: part(d, "lua+") and not part(d, "f#")),
    ("Lua+ AND F#", [], lambda d: part(d, "lua+") and part(d, "f#")),
    ("cobol perlite", [], lambda d: part(d, "cobol") or part(d, "perlite")),
    ("patient AND archivist", [W], lambda d: word(d, "patient") and word(d, "archivist")),
    ("keeper NOT vue", [W], lambda d: word(d, "keeper") and not word(d, "vue")),
    ("NOT patient", [], lambda d: not part(d, "patient")),
    ("cobol, gardener", [W, S], lambda d: True),
    ("solidjs", [], lambda d: part(d, "solidjs")),
    ('"signal box keeper"', [W], lambda d: "Signal Box Keeper" in d["work_experiences"]),
    ('"keeper box signal"', [W], lambda d: False),
    ('"Gardener"', [], lambda d: "Gardener" in d["work_experiences"]),
    ("zymurgy", [], lambda d: False),
    ("the of", [], lambda d: False),
]
KEYWORDS = [(k, f, {d["id"] for d in DOCUMENTS if fits(d, {}) and meant(d)}) for k, f, meant in MEANT]


@pytest.mark.parametrize("params,wanted", FACETS)
def test_facets(spark, profiles, params, wanted):
    assert ids(search(spark, profiles, params)) == wanted


@pytest.mark.parametrize("keywords,features,wanted", KEYWORDS)
def test_keywords(spark, profiles, keywords, features, wanted):
    found = search(spark, profiles, {"keywords": keywords, "features": features})
    assert set(ids(found)) == wanted


@pytest.mark.parametrize("keywords", ["vue", "vue.js", "vuejs"])
def test_a_trailing_js_is_no_part_of_a_word(spark, tables, keywords):
    found = search(spark, tables(33, 34), {"keywords": keywords, "features": [W]})
    assert set(ids(found)) == {34}


def test_keywords_with_facets(spark, profiles):
    both = {"keywords": "maps", "work_locations": ["Graz"], "languages": ["Welsh"]}
    assert set(ids(search(spark, profiles, both))) == {31, 33}
    assert ids(search(spark, profiles, {"keywords": "signal", "ignored_talents": [33]})) == [34]
    assert ids(search(spark, profiles, {"keywords": "signal", "ignored_talents": "33, 34"})) == []


def test_optional_keywords_rank_only(spark, tables):
    rows = search(spark, tables(31, 35), {"keywords": "perl", "features": [W, S]}).collect()
    assert [r["id"] for r in rows] == [31, 35]
    assert rows[0]["highlight"] and rows[1]["highlight"] is None
    assert rows[0]["score"] > 0 and rows[1]["score"] == 0


def test_highlight(spark, profiles):
    hit = search(spark, profiles, {"keywords": "mainframes"}).first()
    assert [part.strip() for part in hit["highlight"]["summary"]] == ["mainframes"]
    words = search(spark, profiles, {"keywords": "surveyor", "features": [W]}).first()
    assert {k: [x.strip() for x in v] for k, v in words["highlight"].items()} == {"headline.keyword": ["surveyor"]}
    exact = search(spark, profiles, {"keywords": '"COBOL"'}).first()
    assert exact["highlight"] == {"skills.raw": ["COBOL"]}
    assert all(r["highlight"] is None for r in search(spark, profiles, {}).collect())


def test_totals_and_json(spark, profiles):
    assert search(spark, profiles, {"per_page": 1}, total_hits).first()["total"] == len(expected({}))
    assert search(spark, profiles, {"bookmarked_talents": "31,32,34"}, total_hits).first()["total"] == 2
    result = search(spark, profiles, {"per_page": 2, "debug": "true"}, search_results)
    decoded = json.loads(to_json(result).first()["value"])
    assert decoded["total"] == len(expected({}))
    assert [t["talent"]["id"] for t in decoded["talents"]] == expected({})[:2]
    assert decoded["talents"][0]["highlight"] is None
    assert "Physical Plan" in decoded["raw_es_query"]
    plain = json.loads(to_json(search(spark, profiles, {}, search_results)).first()["value"])
    assert plain["raw_es_query"] is None


def test_min_score_cuts_page_and_total(spark, profiles):
    base = {"as_of": AS_OF, "keywords": "maps patient"}
    everything = all_hits(profiles, SearchRequest.from_params(spark, base)).collect()
    cut = everything[0]["score"]
    request = SearchRequest.from_params(spark, base, min_score=cut)
    assert ids(search_profiles(profiles, request)) == [
        r["id"] for r in everything if r["score"] >= cut
    ]
    assert total_hits(profiles, request).first()["total"] == len(
        [r for r in everything if r["score"] >= cut]
    )


def test_role_projection_pads(spark, profiles):
    rows = {r["id"]: r for r in search(spark, profiles, {}).collect()}
    assert [tuple(x) for x in rows[31]["roles_experiences"]] == [("Cartographer", "4..6"), ("Archivist", "0..1")]
    assert rows[35]["roles_experiences"] == []


def test_missing_table_is_empty(spark, profiles):
    profiles.createOrReplaceTempView("people")
    empty = profiles.limit(0)
    assert select_table(spark, "people", None, empty).count() == len(DOCUMENTS)
    missing = select_table(spark, "people", "no_such_index", empty)
    assert ids(search(spark, missing, {"index": "no_such_index"})) == []


def test_explain(spark, profiles):
    assert "TakeOrderedAndProject" in explain_search(profiles, SearchRequest(as_of=AS_OF))


def test_pages_add_up_to_the_full_order(spark, profiles):
    for params in ({}, {"keywords": "maps keeper Lua+"}):
        full = ids(search(spark, profiles, params, all_hits))
        pages = [
            ids(search(spark, profiles, {**params, "per_page": 1, "offset": i})) for i in range(6)
        ]
        assert sum(pages, []) == full
