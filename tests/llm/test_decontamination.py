import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from profilescope.llm import decontamination
from profilescope.llm.decontamination import (
    ClassIndex, TextTerms, find_leaks, overlap, question_and_answer, terms_of, without_leaks,
)

from .conftest import words

ITEMS = [
    (1, "Wie viele Monde hat der Saturn? " + words(50, 20) + ". Es sind viele Monde."),
    (2, words(51, 30)),
    (3, "Kurze Frage hier heute? Ja gewiss."),
    (None, words(52, 25)),
    (5, None),
    (6, ""),
    (7, words(51, 30)),
]


@settings(deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.floats(0.05, 1.5))
def test_wand_finds_what_full_scoring_finds(seed, items, least):
    rng = random.Random(seed)
    index, full = ClassIndex(8, 12), {}
    for term in range(12):
        for item in rng.sample(range(items), rng.randrange(items + 1)):
            score = rng.randrange(1, 30) / 64
            index.raw[term].append((item, score))
            full.setdefault(item, {})[term] = score
    index.close(items)
    terms = rng.sample(range(12), rng.randrange(1, 12))
    totals = {i: sum(s for t, s in x.items() if t in terms) for i, x in full.items()}
    want = {i: s for i, s in totals.items() if s >= least - 1e-9 and any(t in terms for t in full[i])}
    got = dict(index.retrieve(terms, least))
    assert got.keys() == want.keys()
    if want:
        assert index.may_hold(np.array(terms), least)


@settings(deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 90), st.floats(0.05, 1.5), st.integers(1, 4096))
def test_bounds_leave_out_no_passage(seed, size, least, bounded):
    """Whatever is summed at once, every passage that holds an item's score is among those that the bounds leave."""
    rng = random.Random(seed)
    index, full = ClassIndex(4, 20), {}
    for term in range(20):
        for item in rng.sample(range(100), rng.randrange(30)):
            score = rng.randrange(1, 30) / 64
            index.raw[term].append((item, score))
            full.setdefault(item, {})[term] = score
    index.close(100)
    numbers = np.array([rng.randrange(21) for _ in range(size)], dtype=np.int64)
    before, decontamination.BOUNDED = decontamination.BOUNDED, bounded
    try:
        left = list(index.passages(TextTerms(numbers), least))
    finally:
        decontamination.BOUNDED = before
    assert left == sorted(set(left))
    for start in range(0, max(1, size - 4), 4):
        held = set(numbers[start : start + 8].tolist())
        if any(sum(s for t, s in x.items() if t in held) >= least for x in full.values()):
            assert (start, min(start + 8, size)) in left


def test_leaks_match_brute_force(spark, monkeypatch):
    rng, rows, want = random.Random(8), [], set()
    for i in range(60):
        parts = words(200 + i, rng.randrange(1, 300)).split()
        if i % 4 == 0:
            number, text = ITEMS[rng.choice([0, 1, 2])]
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = (text.upper() if i % 8 else text).split()
            want |= {(i, number)} | ({(i, 7)} if number == 2 else set())
        rows.append((i, " ".join(parts), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = find_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert all(r["score"] > 0.99 and r["question_overlap"] == r["answer_overlap"] == 1 for r in found)
    assert {r["doc_id"] for r in without_leaks(docs, items).collect()} == set(range(60)) - {d for d, _ in want}
    monkeypatch.setattr(decontamination, "INDEX_BYTES", 100)  # several indexes
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()} == want


def test_odd_documents(spark, odd, odd_rows, none):
    items = spark.createDataFrame([*ITEMS, (8, words(3, 40))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in find_leaks(odd, items).collect()] == [(None, 8)]
    kept = without_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 1
    assert find_leaks(none, items).count() == 0
    assert find_leaks(odd, items.where("false")).count() == 0
    assert without_leaks(odd, items.where("item_id > 100")).count() == len(odd_rows)


def test_parts_of_an_item():
    assert question_and_answer("One two?\nThree.") == ([b"one", b"two"], [b"three"])
    assert question_and_answer("One two? Three four.") == ([b"one", b"two"], [b"three", b"four"])
    assert question_and_answer("a b c d e f g h") == ([b"a", b"b", b"c", b"d", b"e", b"f"], [b"g", b"h"])
    assert overlap([], [b"x"]) == 1 and overlap([b"a", b"b"], [b"b", b"a", b"b"]) == 1
    assert terms_of("### Äpfel, (x)") == ["äpfel".encode(), b"x"]
