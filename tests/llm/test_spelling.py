import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from profilescope.llm import spelling
from profilescope.llm.automata import Acceptor, OneEdit
from profilescope.llm.spelling import near_words, op13, variants, vocabulary


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_pairs(words):
    words = sorted(words)
    return sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))


def brute(rows):
    """The contract's rows for (doc_id, text), word by word."""
    n = Counter()
    for doc_id, text in rows:
        for found in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in found)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def as_rows(frame):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", max_size=6), max_size=40))
def test_composition_accepts_all_pairs_once(words):
    ordered = sorted(words)
    acceptor = Acceptor(ordered)
    assert acceptor.size[acceptor.root] == len(ordered)
    for place, word in enumerate(ordered):
        state, number = acceptor.root, 0
        for c in word:
            state, offset = acceptor.arcs[state][c]
            number += offset
        assert acceptor.final[state] and number == place
    found = sorted(tuple(sorted((ordered[i], ordered[j]))) for i, j in OneEdit(acceptor).pairs())
    assert found == brute_pairs(words)


def test_acceptor_is_minimal():
    acceptor = Acceptor(sorted(a + b for a in ("x", "y", "zz") for b in ("tag", "tage", "nacht")))
    endings = set()

    def language(state):
        found = {""} if acceptor.final[state] else set()
        for c, (target, _) in acceptor.arcs[state].items():
            found |= {c + rest for rest in language(target)}
        return frozenset(found)

    for state in range(len(acceptor.final)):
        endings.add(language(state))
    assert len(endings) == len(acceptor.final)


@pytest.mark.parametrize("most", [4096, 30, 3, 1])
def test_partitions_lose_and_repeat_no_pair(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "WORDS", most)
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))) for _ in range(300)}
    words |= {"vorsilbe" + "".join(rng.choice("ab") for _ in range(5)) for _ in range(60)} | {"vorsilb", "vorsilbe", "vorsilbea"}
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long").repartition(3)
    found = sorted(tuple(sorted((r["word"], r["other"]))) for r in near_words(frame).collect())
    assert found == brute_pairs(words)


def test_documents_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "WORDS", 50)
    monkeypatch.setattr(spelling, "COUNTED", 40)
    rng = random.Random(4)
    vocabulary_ = [("".join(rng.choice("abcdeé×") for _ in range(rng.randrange(4, 9)))) for _ in range(150)]
    vocabulary_ += [w[:i] + w[i + 1 :] for w in vocabulary_ for i in (1, 3)] + ["ABCDE", "Ünder", "ünder", "abc1defgh"]
    rows = [(i, " ".join(rng.choices(vocabulary_, k=120))) for i in range(60)] + [(99, None), (99, ""), (7, "... 12")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert as_rows(op13(docs)) == want and any(r[1] for r in want)


def test_roots_follow_long_chains_and_ties(spark):
    words = [("a" * 5 + "b" * i, 2**i) for i in range(20)] + [("zzzzzx", 8), ("zzzzzy", 8), ("zzzzz", 4), ("zzzzza", 5)]
    rows = {r["word"]: r for r in variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert all(rows["aaaaa" + "b" * i]["root"] == "aaaaa" + "b" * 19 for i in range(20))
    assert rows["aaaaa"]["form"] == "aaaaab" and rows["aaaaa" + "b" * 19]["form"] is None
    assert rows["zzzzz"]["form"] == rows["zzzzz"]["root"] == "zzzzzx" and rows["zzzzz"]["n_near"] == 3
    assert rows["zzzzza"]["form"] is None and rows["zzzzza"]["form_n"] is None


def test_one_unbroken_megabyte(spark):
    rng = random.Random(6)
    long_word = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    other = long_word[:500_000] + "z" + long_word[500_000:]
    docs = spark.createDataFrame([(1, f"{long_word} " * 3 + f"{other} " * 7)], "doc_id long, text string")
    found = variants(vocabulary(docs)).select("n", "n_near", "form_n").orderBy("n").collect()
    assert [tuple(r) for r in found] == [(3, 1, 7), (7, 1, None)]


def test_odd_documents(odd, odd_rows, none):
    assert as_rows(op13(odd)) == brute([(("" if r[0] is None else r[0]), r[1]) for r in odd_rows])
    assert op13(none).count() == 0
    assert op13(odd).columns == ["word", "form", "root", "n", "n_near", "form_n"]
