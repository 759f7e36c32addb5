import itertools
import random

import pytest
from profilescope.llm.url_rules import RULES, host_and_path, judge, mine, mined_verdicts, op2, page_labels

URLS = [
    "http://a.net/x", "https://EXAMPLE.net/en/1", "http://example.net/en", "http://www.example.net/EN/", "http://net", "net/",
    None, "", "http://x.example.com/de/2?x#y", "http://example.com/fr/", "ftp://b.org/fr/a", "http://b.org/fr?q=/fr/",
    "http://notexample.com/de/", "http://example.net:80/en/", "http:///net/", "x://y://z.net/", "http://a.net?://b.org/fr/",
]


def told(url):
    """(host, path, rule, listed verdict) by the definition."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for rule, verdict in RULES:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    rows = judge(pages, None).collect()
    assert len(rows) == len(URLS) * 2
    for r in rows:
        host, path, rule, listed = told(URLS[r["page_id"] % len(URLS)])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, listed or "allow")


def test_mined_rules_block_what_was_labelled_bad(spark):
    """Casino paths are bad on one host only: neither token alone says so."""
    rows, labels = [], []
    for i in range(400):
        host, path = ("shop", "casino", "shop", "blog")[i % 4], ("news", "slots")[i // 4 % 2]
        rows.append((i, f"http://{host}.example.edu/{path}/{i}"))
        if i % 3:
            labels.append((f"http://{host}.example.edu/{path}/{i}", host == "casino" and path == "slots"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = judge(pages, spark.createDataFrame(labels, "url string, bad boolean")).collect()
    for r in got:
        bad = r["host"].startswith("casino") and r["path"].startswith("/slots")
        assert (r["verdict"] == "block") == bad, r


def test_frequent_token_of_urls_with_many_tokens(spark):
    """The bad path is the most frequent token of its pages, and each has 14 rarer ones that are frequent too."""
    keys = [[f"q{g}x{chr(97 + i)}" for i in range(14)] for g in range(10)]
    urls = [("http://a.edu/slots?" + "&".join(f"{k}=1" for k in keys[i % 10]), True) for i in range(300)]
    urls += [(f"http://a.edu/news/{i}", False) for i in range(300)]
    pages = spark.createDataFrame([(1, "http://b.edu/slots"), (2, "http://b.edu/news/1")], "page_id long, url string")
    got = judge(pages, spark.createDataFrame(urls, "url string, bad boolean")).collect()
    assert {r["page_id"]: (r["verdict"], r["bad_confidence"]) for r in got} == {1: ("block", 1.0), 2: ("allow", None)}


@pytest.mark.parametrize("seed", [1, 2])
def test_confidences_match_brute_force(spark, seed):
    """Every token set gets the confidence of the best of all combinations, whatever is left out on the way."""
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        has = {t for t in "abcdef" if rng.random() < 0.4} | {"every"}
        has |= {f"{t}{t}" for t in has & {"a", "b"}}  # always with a, always with b
        has |= {"wide"} if "c" in has or rng.random() < 0.3 else set()
        rows.append((sorted(has), "d" in has and "e" in has or rng.random() < (0.8 if "wide" in has else 0.3)))
    tokens = sorted({t for r in rows for t in r[0]})
    best = {}
    for n in range(1, len(tokens) + 1):
        for some in itertools.combinations(tokens, n):
            of = [bad for has, bad in rows if set(some) <= set(has)]
            if sum(of) >= 6 and sum(of) / len(of) >= 0.6:
                best[some] = sum(of) / len(of)
    asked = [["a"], ["aa"], ["aa", "c"], ["every", "x"], ["x"], ["b", "d"], *[r[0] for r in rows[:40]]]
    sets = spark.createDataFrame([(str(i), a) for i, a in enumerate(asked)], "token_set string, tokens array<string>")
    rules = mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.001, 6, 0.6)
    got = {r["token_set"]: r["confidence"] for r in mined_verdicts(sets, rules).collect()}
    want = {str(i): max((c for some, c in best.items() if set(some) <= set(a)), default=None) for i, a in enumerate(asked)}
    assert got == {i: pytest.approx(c) for i, c in want.items() if c is not None}


def test_odd_pages_and_labels(spark):
    pages = spark.createDataFrame([(None, None), (1, "http://a.org/en/5"), (1, "http://a.org/en/5")], "page_id long, url string")
    labels = spark.createDataFrame(
        [(5, 1, 0), (5, None, 1), (6, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int"
    )
    assert [tuple(r) for r in page_labels(pages, labels).collect()] == [("http://a.org/en/5", True)] * 2
    assert op2(pages, labels).count() == 3
    assert op2(pages, labels.where("false")).count() == 3
    assert op2(pages.where("false"), labels).count() == 0
    assert host_and_path(pages).where("host IS NULL").count() == 0
