import math
import random

import numpy as np
from profilescope.llm.quality import Features, fit, grade_labels, keep_good, rate_documents

from .conftest import CLASHING, words


def corpus(n=1500):
    """Good, poor (marked words) and toxic (two telling words) texts by turns."""
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        text = words(i, 25)
        if i % 3 == 1:
            text = " ".join(w + "###" for w in text.split())
        if i % 3 == 2:
            text += " " + rng.choice(["vile scum", "rotten scum", "vile rotten"])
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(i % 3 != 1), int(i % 3 == 2)))
    return rows, labels


def test_ordinal_fit_orders_grades():
    rows, labels = corpus()
    features = Features()
    grades = np.array([{0: 2, 1: 1, 2: 0}[i % 3] for i in range(len(rows))])
    model = fit([features.places(r[1]) for r in rows[:1200]], grades[:1200])
    assert (np.diff(model.thresholds) > 0).all()
    scores = np.array([model.weights[features.places(r[1])].sum() for r in rows[1200:]])
    below = model.at_most(scores)
    assert (below[:, 0] <= below[:, 1]).all()
    expected, tail = model.expected_and_tail(scores)
    assert np.mean(tail[grades[1200:] == 2] > 0.3) > 0.97 and np.mean(tail[grades[1200:] == 0] < 0.3) > 0.97
    assert expected[grades[1200:] == 0].mean() < expected[grades[1200:] == 1].mean() < expected[grades[1200:] == 2].mean()


def test_no_or_one_grade():
    for grades in ([], [2, 2, 2]):
        model = fit([np.array([1, 2])] * len(grades), np.array(grades, dtype=int))
        assert not model.weights.any() and (np.diff(model.thresholds) > 0).all()


def test_held_out_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    rated = spark.createDataFrame(labels[:1200], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in keep_good(docs, rated).collect()}
    good, toxic = ({i for i in range(1200, 1500) if i % 3 == k} for k in (0, 2))
    assert len(good - kept) <= 3 and len(toxic & kept) <= 3


def test_odd_documents_and_labels(spark, odd, odd_rows, none):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 1), (3, 0, 0), (None, 1, 0), (4, None, None), (8, 1, None), (777, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    assert {tuple(r) for r in grade_labels(labels).collect()} == {(1, 0), (3, 1), (8, 2), (777, 2)}
    rows = rate_documents(odd, labels).collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)
    assert all(isinstance(r["selected"], bool) for r in rows)
    assert {r["key"] for r in rows} == {"clash"} and set(CLASHING) <= set(rate_documents(odd, labels).columns)
    same = {r["tail_probability"] for r in rows if r["text"] in (None, "", " \n\t ")}
    assert len(same) == 1
    nothing = labels.where("false")
    assert len({r["tail_probability"] for r in rate_documents(odd, nothing).collect()}) == 1
    assert rate_documents(none, labels).count() == 0
    assert keep_good(odd, labels).columns == odd.columns


def objective(weights, thresholds, rows, grades, penalty):
    """The mean negative log-likelihood of the grades with its penalty, row by row from the definition."""
    total = 0.0
    for places, grade in zip(rows, grades, strict=True):
        score = sum(weights[p] for p in places)
        below = [0.0, *(1 / (1 + math.exp(score - t)) for t in thresholds), 1.0]
        total -= math.log(max(below[grade + 1] - below[grade], 1e-12))
    return total / len(grades) + penalty * sum(abs(w) for w in weights.values())


def test_fit_is_the_penalised_likelihoods_minimum():
    """No small step in any direction from the fitted weights and thresholds makes the objective smaller."""
    rng = random.Random(8)
    rows = [sorted(rng.sample(range(5), rng.randrange(1, 4))) for _ in range(60)]
    grades = [min(2, max(0, round(1 + 0.8 * (3 in r) - 0.9 * (1 in r) + rng.gauss(0, 0.7)))) for r in rows]
    model = fit([np.array(r) for r in rows], np.array(grades), steps=6000)
    weights, cuts = {p: float(model.weights[p]) for p in range(5)}, [float(t) for t in model.thresholds]
    penalty = 1.6 / len(rows)
    least = objective(weights, cuts, rows, grades, penalty)
    assert cuts == sorted(cuts) and weights[3] > 0 > weights[1]
    for size in (0.3, 0.03, 0.01):
        for _ in range(60):
            moved = {p: w + rng.choice([-1, 0, 0, 1]) * size for p, w in weights.items()}
            shifted = [t + rng.choice([-1, 0, 1]) * size for t in cuts]
            if shifted == sorted(shifted):
                assert objective(moved, shifted, rows, grades, penalty) > least - 2e-4
    scores = np.array([sum(weights[p] for p in r) for r in rows])
    expected, tail = model.expected_and_tail(scores)
    for score, e, t in zip(scores, expected, tail, strict=True):
        chances = np.diff([0, *(1 / (1 + math.exp(score - c)) for c in cuts), 1])
        assert abs(e - chances @ np.arange(3)) < 1e-6 and abs(t - chances[2]) < 1e-6
