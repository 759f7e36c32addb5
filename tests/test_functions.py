import os
import random

import pytest

from profilescope.functions import predicates, text
from profilescope.functions import values as v
from profilescope.functions.calendar import instant_cells, window_cells
from profilescope.functions.keywords import analyse_keywords
from profilescope.operators.fulltext import content_test, matchable


def rows(spark, values):
    return spark.createDataFrame([(x,) for x in values], "x string")


def evaluate(spark, values, sql):
    return [r[0] for r in rows(spark, values).coalesce(1).selectExpr(sql).collect()]


# The ranges, each with the last year in it.
RANGES = {"0..1": 1, "1..2": 2, "2..4": 4, "4..6": 6, "6..8": 8, "8+": 255}


def test_experience_ladder(spark):
    """For every number of years that a request can name: the ranges that don't end before it."""
    want = [[name for name, last in RANGES.items() if last >= years] for years in range(256)]
    assert evaluate(spark, [str(k) for k in range(256)], v.experience_ranges("cast(x AS int)")) == want
    assert [predicates.ranges_from(k) for k in range(256)] == want


def role_filter(asked):
    """The rule: a name, then up to two numbers of one byte, the second no less than the first; what follows something
    else is not read."""
    name, *limits = asked.strip().split(":")
    numbers = []
    for limit in limits[:2]:
        if not limit.isdigit() or int(limit) > 255 or (numbers and int(limit) < numbers[0]):
            break
        numbers.append(int(limit))
    return (name, *numbers, *[None] * (2 - len(numbers))) if asked.strip() else None


def test_role_filters(spark):
    rng = random.Random(31)
    names = ["Ferry pilot", "q", "Glass/blower", "Überbauer"]
    limits = [lambda: str(rng.randrange(256)), lambda: str(rng.randrange(256, 999)), lambda: rng.choice(["", "x", "2y", "-1", "1.5"])]
    cases = ["", " ", "\t \n"]
    for _ in range(200):
        asked = ":".join([rng.choice(names), *(rng.choice(limits)() for _ in range(rng.randrange(3)))])
        cases.append(rng.choice(["", " ", "  "]) + asked + rng.choice(["", " "]))
    got = evaluate(spark, cases, v.parse_role_filter("x"))
    assert [None if r is None else tuple(r) for r in got] == [role_filter(c) for c in cases]


def test_calendar_cells(spark):
    """An instant shares exactly one cell with a window if its month is one of the window's, else none."""
    rng = random.Random(17)
    moment = lambda: f"{rng.choice([1, 9, 10, 999, 1000, 1899, 1900, 1995, 1999, 2000, 2026, 9999, rng.randrange(1, 9999)]):04d}"
    day = lambda: f"{moment()}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}:30:00"
    rows_ = [(*sorted((day(), day())), day()) for _ in range(600)]
    rows_ += [("0001-01-01T00:00:00", "9999-12-31T23:00:00", day()) for _ in range(20)] + [(x, x, x) for _, x, _ in rows_[:20]]
    frame = spark.createDataFrame(rows_, "a string, b string, t string").coalesce(2)
    typed = frame.selectExpr("a", "b", "t", *(f"cast({c} AS timestamp_ntz) AS {c}_" for c in "abt"))
    met = typed.selectExpr("a", "b", "t", f"{window_cells('a_', 'b_')} AS cells", f"{instant_cells('t_')} AS own")
    inside = 0
    for r in met.collect():
        shared = set(r["cells"]) & set(r["own"])
        assert len(shared) == (r["a"][:7] <= r["t"][:7] <= r["b"][:7]), r
        assert len(set(r["cells"])) == len(r["cells"]) <= 94
        inside += len(shared)
    assert 100 < inside < 600


def test_parameters(spark):
    lists = evaluate(spark, ['["Weaver","Dyer"]', '[""]', "plain", None, '{"a":1}'], v.string_list("x"))
    assert lists == [["Weaver", "Dyer"], [""], [], [], []]
    ids = evaluate(spark, ["1, 4", "2,x,,3", "a,b", '["1","2"]', '["1","x"]', None, "5000000000"], v.int_list("x"))
    assert ids == [[1, 4], [2, 3], [], [1, 2], [], [], []]
    assert evaluate(spark, ["4", "", "not a number", '["1"]', None], v.int_scalar("x")) == [[4], [], [], [], []]
    assert evaluate(spark, ["7", "-1", "x", None], v.page_offset("x")) == [7, 0, 0, 0]
    assert evaluate(spark, ["7", "x", None], v.page_size("x")) == [7, 10, 10]
    moments = evaluate(spark, ["2016-03-04T12:24:00+01:00", "2016-03-04", "soon"], v.instant("x"))
    assert [m and m.isoformat() for m in moments] == ["2016-03-04T11:24:00", "2016-03-04T00:00:00", None]


def test_analyzers(spark):
    assert evaluate(spark, ["C++,React.js"], text.delimited_tokens("lower(x)")) == [
        ["c++,react.js", "c", "react", "js", "creactjs"]
    ]
    assert evaluate(spark, ["john's wi-fi2"], text.substring_tokens("x")) == [
        ["john's", "john", "wi-fi2", "wi", "fi", "2", "wifi2"]
    ]
    assert evaluate(spark, ["john's wi-fi2 -- a"], text.substring_positions("x")) == [6]
    assert evaluate(spark, ["The C++, React.js and js Node."], text.word_tokens("x")) == [["c", "react", "", "node"]]
    assert evaluate(spark, ["abcd"], text.grams("x", 2, 3)) == [["ab", "bc", "cd", "abc", "bcd"]]
    assert evaluate(spark, ["a"], text.grams("x")) == [[]]
    phrase = text.match_phrase(text.standard_tokens("x"), ["b", "c"])
    assert evaluate(spark, ["a b c", "b a c", "bc"], phrase) == [True, False, False]
    assert evaluate(spark, ["a b", "c"], text.match_tokens(text.standard_tokens("x"), ["b", "z"])) == [True, False]


def test_keyword_clauses(spark):
    def clauses(keywords, whole_words=False):
        return [(c.occur, c.tokens) for c in analyse_keywords(spark, keywords, whole_words).clauses]

    assert clauses("a1 OR b1 AND NOT c1 d1") == [
        ("should", ("a1", "1")), ("must", ("b1", "b", "1")),
        ("must_not", ("c1", "c", "1")), ("should", ("d1", "d", "1")),
    ]
    assert clauses("+xx -yy zz") == [("must", ("xx",)), ("must_not", ("yy",)), ("should", ("zz",))]
    assert clauses("the and of") == []
    assert clauses('"Right now" Foo') == [("should", ("Right now",)), ("should", ("Foo",))]
    assert clauses('"state of the Art" Foo.js', True) == [("should", ("state\n \n \nart",)), ("should", ("foo",))]
    assert analyse_keywords(spark, "", False) is None


def test_folded_text_equals_grams(spark):
    """A term matches the folded text exactly when it is an indexed gram of some delimited token."""
    random.seed(7)
    letters = ["a", "b", "js", "'s", "+", ".", "-", "1", "é", " ", "\n", "in", "C#"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(300)]
    terms = sorted({t for x in texts[:60] for w in x.lower().split() for t in (w, w[1:], w[:3], w[1:4]) if t})
    stops = set(text.ENGLISH_STOP_WORDS + text.TECH_STOP_WORDS)
    terms = [t for t in terms if t not in stops][:150]
    frame = rows(spark, texts).coalesce(4)
    grams = f"flatten(transform({text.substring_tokens('x')}, t -> {text.grams('t')}))"
    tests = ", ".join(
        content_test("folded", "substring", t) if matchable("substring", t) else "false" for t in terms
    )
    checked = frame.selectExpr("x", f"{grams} AS grams", f"{text.substring_index('x')} AS folded").selectExpr(
        "x", "grams", f"array({tests}) AS hits"
    )
    hits = 0
    for r in checked.collect():
        for term, hit in zip(terms, r["hits"]):
            assert hit == (term in r["grams"]), (r["x"], term)
            hits += hit
    assert hits > 100


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_plans(spark):
    """Facets reach the scan, unread joins vanish, and nothing needs a cross join or Python."""
    import contextlib
    import io

    from profilescope.operators.batch import match_facets
    from profilescope.operators.search import search_profiles
    from profilescope.plans import binding
    from profilescope.plans.requests import SearchRequest, decode_requests

    def plan(frame):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            frame.explain("formatted")
        return out.getvalue()

    people = binding.profiles(spark, DATA)
    narrow = plan(people.select("id", "headline"))
    assert "lineitem" not in narrow and "orders" not in narrow
    from profilescope.session import scratch_path

    stored = scratch_path(spark, "people")
    people.write.parquet(stored)
    stored_people = spark.read.parquet(stored)
    page = plan(search_profiles(stored_people, SearchRequest(as_of=binding.AS_OF, work_authorization=("yes",))))
    assert "PushedFilters: [" in page and "EqualTo(work_authorization,yes)" in page and "TakeOrderedAndProject" in page
    assert "summary" not in page.split("ReadSchema")[1]
    requests = decode_requests(binding.raw_requests(spark, DATA))
    pairs = plan(match_facets(requests, stored_people))
    assert "CartesianProduct" not in pairs and "NestedLoop" not in pairs and "Python" not in pairs


def test_large_request_tables_are_salted(spark, profiles, monkeypatch):
    """The way for request tables too large to broadcast gives the same pairs."""
    from test_batch import MIXED, raw_requests

    from profilescope.operators import batch, postings
    from profilescope.plans.requests import decode_requests

    raw = raw_requests(spark, MIXED[:20] + MIXED[40:46])
    requests = spark.createDataFrame(decode_requests(raw).collect(), decode_requests(raw).schema)
    key = lambda r: (r["request_id"], r["id"], r["score"] or 0)
    small = sorted(map(key, batch.match_saved_searches(requests, profiles).collect()))
    monkeypatch.setattr(batch, "is_small", lambda *_: False)
    monkeypatch.setattr(postings, "is_small", lambda *_: False)
    large = sorted(map(key, batch.match_saved_searches(requests, profiles).collect()))
    assert small == large and small
