import math
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from profilescope.llm import language_model
from profilescope.llm.language_model import held_out, score_documents
from profilescope.llm.recurrent import CLASS, HIDDEN, GatedModel

from .conftest import words


def test_token_probabilities_add_up_to_one():
    model = GatedModel(np.array([5.0, 4, 3, 2, 1] * 30) / 450)
    model.train([np.arange(150) % 150 for _ in range(20)])
    state = np.random.default_rng(0).normal(size=(1, HIDDEN)).astype(np.float32)
    every = np.arange(150)
    total = np.exp(model.log_probabilities(np.repeat(state, 150, 0), every)).sum()
    assert total == pytest.approx(1, abs=1e-4)
    assert model.classes == -(-150 // CLASS)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    model = GatedModel(np.full(130, 1 / 130))
    model.token_out = rng.normal(0, 0.3, model.token_out.shape)
    model.class_out = rng.normal(0, 0.3, model.class_out.shape)
    for name in model.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64))
    window, starts = rng.integers(0, 130, (5, 2)), np.zeros((5, 2), dtype=bool)
    starts[0] = starts[3, 1] = True
    found = {}
    model._update = lambda name, g, rows: found.update({name: (g.copy() * 2, rows)})

    def loss():
        state, total = np.zeros((2, HIDDEN)), 0.0
        for t in range(5):
            state = np.where(starts[t][:, None], 0, state)
            total -= model.log_probabilities(state, window[t]).sum()
            state = model.step(state, window[t])
        return total

    model.learn(window, starts, np.zeros((2, HIDDEN)))
    g, rows = found["table"]
    checks = [("table", (rows[0], 3), g[0, 3]), ("recurrent", (2, 5), found["recurrent"][0][2, 5])]
    checks += [("class_out", (1, 0), found["class_out"][0][1, 0]), ("recurrent", (1, 40), found["recurrent"][0][1, 40])]
    for name, at, want in checks:
        value = getattr(model, name)
        value[at] += 1e-5
        high = loss()
        value[at] -= 2e-5
        low = loss()
        value[at] += 1e-5
        assert (high - low) / 2e-5 == pytest.approx(want, abs=1e-3)


def test_scores_of_whole_documents_do_not_depend_on_company():
    model = GatedModel(np.arange(200, 0, -1) / 20100)
    model.train([np.arange(300) % 200 for _ in range(10)])
    docs = [np.arange(n) % 200 for n in (1, 15, 16, 17, 100, 333)]
    together = model.score(docs)
    for doc, score in zip(docs, together, strict=True):
        state, total = np.zeros((1, HIDDEN), np.float32), 0.0
        for token in doc:
            total += float(model.log_probabilities(state, np.array([token]))[0])
            state = model.step(state, np.array([token]))
        assert score == pytest.approx(total, rel=1e-4)


@pytest.mark.parametrize("head", [10, 200_000])
def test_base_scores_match_definition(spark, odd, odd_rows, none, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD", head)
    monkeypatch.setattr(language_model, "OUTPUTS", 20)
    rows = [r[:2] for r in odd_rows] + [(i, words(i, 50)) for i in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = [(i, (t or "").lower().split() + ["\n"]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), out[i], len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4))
        for i, ws in tokens
    )
    got = score_documents(docs).collect()
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    figures = ((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    assert sorted((str(a), b, c, d, e, round(f, 4)) for a, b, c, d, e, f in figures) == want
    if head > 10:
        assert score_documents(odd).count() == len(odd_rows)
        assert score_documents(none).count() == 0
        assert held_out(odd).where("doc_id IS NULL AND held_out").count() == 0


def test_without_training_documents():
    nothing = np.zeros(language_model.RARE, dtype=np.int64)
    known = language_model.Vocabulary([], np.array([], dtype=np.int64), 0, 0, nothing, nothing, 0)
    words_, codes = known.encode("a b", known.codes())
    assert len(words_) == 3 and (codes < 0).all()
    model = GatedModel(known.shares)
    assert np.isfinite(model.score([known.outputs(codes)])).all() and model.train([]) == 0


def test_every_training_document_is_learned_from_once(spark, monkeypatch, tmp_path):
    seen = str(tmp_path)

    def learner(known, parameters):
        def run(batches):
            for batch in batches:
                with tempfile.NamedTemporaryFile("w", dir=seen, delete=False) as file:
                    file.writelines(f"{text}\n" for text in batch.column(0).to_pylist())
            yield from ()

        return run

    monkeypatch.setattr(language_model, "_learner", learner)
    docs = spark.createDataFrame([(i if i % 9 else None, f"text {i // 2}") for i in range(300)], "doc_id long, text string")
    rows = held_out(docs)
    language_model.train(rows, language_model.vocabulary(language_model.count_words(rows)))
    learned = sorted(line for file in tmp_path.iterdir() for line in file.read_text().splitlines())
    assert learned == sorted(r["text"] for r in rows.where("NOT held_out").collect())


def test_held_out_text_is_better_told_than_by_frequencies(spark):
    """Texts of two vocabularies: the state soon knows which one it reads."""
    rows = [(i, words(i, 80, base="left" if i % 2 else "right")) for i in range(400)]
    scored = score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out")
    total = scored.selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert total["s"] > total["b"]


def test_training_makes_its_sums_of_squares_once(monkeypatch):
    made, full = [], np.full
    model = GatedModel(np.full(200, 1 / 200))
    monkeypatch.setattr(np, "full", lambda *a, **k: made.append(a) or full(*a, **k))
    model.train([np.arange(300) % 200 for _ in range(40)])
    assert len(made) == len(model.NAMES)
