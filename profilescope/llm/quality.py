"""Operator 1: quality classifier by ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 toxic, 1 poor, 2 good. One weight vector over hashed text features gives a score s; ordered
thresholds t1 < t2 turn it into P(grade <= j) = logistic(t_j - s) (the proportional-odds model). The expected
grade ranks documents; the tail probability P(grade >= 2) selects them.

Features of a whole text, each present or absent: its words without punctuation, their first five
bytes (which catch inflected words), symbols attached to words, and bands of the shares of upper-case
words, of words with symbols, of bars, of words that repeat the one before and of repeated lines. They are hashed to 2^18 places.

The model is fitted on the driver by proximal AdaGrad with an L1 penalty, on at most ``SAMPLE`` labelled
documents (those with the smallest hash of their id); all documents are scored, in one pass without a shuffle,
by tasks that carry the 1 MB of weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilescope.llm.common import set_aside, words_of

DIMENSIONS = 1 << 18
GRADES = 3
#: Labelled documents to fit on, at most.
SAMPLE = 8_000
#: Share of probability that must lie on the selected grades.
MIN_TAIL = 0.3
#: Words whose places a worker remembers.
CACHED_WORDS = 300_000
_EDGE = b".,;:!?\"'()[]{}<>#$%&*|~-_=+/\\"


class Features:
    """Hashed features of a text: distinct places, in an order that the text alone decides."""

    def __init__(self) -> None:
        self.words: dict[bytes, tuple[tuple[int, ...], bool]] = {}

    @staticmethod
    def place(name: bytes) -> int:
        return zlib.crc32(name) & (DIMENSIONS - 1)

    def of_word(self, word: bytes) -> tuple[tuple[int, ...], bool]:
        """A word's places, and whether two symbols or more end it."""
        found = self.words.get(word)
        if found is None:
            core = word.strip(_EDGE)
            names = [b"w:" + core, b"5:" + core[:5]] if core else []
            tail = word[len(word.rstrip(_EDGE)) :]
            if len(tail) > 1:
                names.append(b"s:" + tail[:8])
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            found = self.words[word] = (tuple(map(self.place, names)), len(tail) > 1)
        return found

    def places(self, text: str | None) -> np.ndarray:
        if not text or not (words := words_of(text)):
            return np.array([self.place(b"empty")], dtype=np.int32)
        seen: set[int] = set()
        symbols = 0
        for word, times in Counter(words).items():
            places, marked = self.of_word(word)
            seen.update(places)
            symbols += times * marked
        lines = text.split("\n")
        for name, part, whole in (
            (b"upper", sum(map(str.isupper, text.split())), len(words)),
            (b"symbols", symbols, len(words)),
            (b"bars", words.count(b"|"), len(words)),
            (b"twice", sum(map(bytes.__eq__, words, words[1:])), len(words)),
            (b"lines", len(lines) - len(set(lines)), len(lines)),
        ):
            band = min(5, (16 * part + whole - 1) // whole)  # 0 is none at all
            seen.add(self.place(b"%s:%d" % (name, band)))
        return np.fromiter(seen, dtype=np.int32, count=len(seen))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # of the places
    thresholds: np.ndarray  # ascending, one fewer than grades

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= j) for each score and each j below the highest grade."""
        return logistic(self.thresholds[None, :] - scores[:, None])

    def expected_and_tail(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below = self.at_most(scores)
        return (1 - below).sum(1), 1 - below[:, -1]


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(
    places: list[np.ndarray],
    grades: np.ndarray,
    grade_count: int = GRADES,
    steps: int = 120,
    rate: float = 0.3,
    least_documents: float = 1.6,
) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty on the weights: full-batch proximal AdaGrad, warm thresholds.

    A feature gets a weight only if it would move the likelihood as ``least_documents`` documents can. Without rows, or with one grade only, all weights stay 0 and
    the thresholds follow the smoothed shares of the grades.
    """
    counts = np.bincount(grades, minlength=grade_count).astype(float)
    shares = (counts + 0.5).cumsum() / (counts + 0.5).sum()
    thresholds = np.log(shares[:-1] / (1 - shares[:-1]))
    weights = np.zeros(DIMENSIONS)
    if len(places) == 0 or (counts > 0).sum() < 2:
        return OrdinalModel(weights.astype(np.float32), thresholds)
    lengths = np.array([len(p) for p in places])
    columns = np.concatenate(places)
    used, columns = np.unique(columns, return_inverse=True)
    starts = np.concatenate([[0], lengths.cumsum()[:-1]])
    of_row = np.repeat(np.arange(len(places)), lengths)
    penalty = least_documents / len(grades)
    importance = np.full(len(grades), 1 / len(grades))
    w, squares = np.zeros(len(used)), np.full(len(used), 1e-10)
    gaps = np.concatenate([thresholds[:1], np.log(np.diff(thresholds))])  # ordered by construction
    gap_squares = np.full(len(gaps), 1e-8)
    rows = np.arange(len(grades))
    for _ in range(steps):
        cuts = np.concatenate([[gaps[0]], gaps[0] + np.exp(gaps[1:]).cumsum()])
        scores = np.add.reduceat(w[columns], starts)
        low = np.concatenate([np.zeros((len(rows), 1)), logistic(cuts[None] - scores[:, None]), np.ones((len(rows), 1))], 1)
        slope = low * (1 - low)
        share = np.maximum(low[rows, grades + 1] - low[rows, grades], 1e-12)
        d_high, d_low = slope[rows, grades + 1] / share, slope[rows, grades] / share
        g_score = importance * (d_high - d_low)  # of the negative log-likelihood
        grad = np.bincount(columns, weights=g_score[of_row], minlength=len(used))
        squares += grad * grad
        step = rate / np.sqrt(squares)
        w = w - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        by_cut = np.zeros(len(cuts) + 2)
        np.add.at(by_cut, grades + 1, -importance * d_high)
        np.add.at(by_cut, grades, importance * d_low)
        g_cut = by_cut[1:-1]
        tail = g_cut[::-1].cumsum()[::-1]
        g_gap = np.concatenate([tail[:1], tail[1:] * np.exp(gaps[1:])])
        gap_squares += g_gap * g_gap
        gaps = gaps - 0.1 * g_gap / np.sqrt(gap_squares)
    weights[used] = w
    return OrdinalModel(weights.astype(np.float32), np.concatenate([[gaps[0]], gaps[0] + np.exp(gaps[1:]).cumsum()]))


def grade_labels(labels: DataFrame) -> DataFrame:
    """One grade per doc_id: 0 toxic, 1 poor, 2 good. Of several ratings the lowest counts; rows without an id
    or without a rating are left out."""
    grade = F.when(F.col("toxic") >= 1, 0).when(F.col("quality") >= 1, 2).when(F.col("quality") < 1, 1)
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    return rated.dropna().groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """The model of at most ``sample`` graded documents, those with the smallest hash of their id."""
    chosen = grade_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    graded = texts.join(F.broadcast(chosen), "doc_id").select("grade", "text")  # bounded by ``sample``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.places(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["grade", "places"]
            )

    got = graded.mapInArrow(run, "grade int, places binary").toArrow()
    rows = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))  # in whatever order they came
    return fit([np.frombuffer(p, dtype=np.int32) for _, p in rows], np.array([g for g, _ in rows], dtype=int))


def score(docs: DataFrame, model: OrdinalModel, min_tail: float = MIN_TAIL) -> DataFrame:
    """Adds ``expected_grade``, ``tail_probability`` and ``selected`` to all documents.

    Nulls: a null or empty text has the feature ``empty`` alone and is scored like any other; a null id is kept.
    Repeated rows are scored each, equal texts alike. Columns of these three names are replaced.
    """
    added = ["expected_grade", "tail_probability", "selected"]
    rest = docs.drop(*added)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rest.schema)}, " + (
        "expected_grade double, tail_probability double, selected boolean"
    )
    at = [f.name for f in rest.schema].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            scores = np.array([float(model.weights[features.places(t.as_py())].sum(dtype=float)) for t in batch.column(at)])
            expected, tail = model.expected_and_tail(scores.reshape(-1))
            more = [pa.array(expected), pa.array(tail), pa.array(tail >= min_tail)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *added])

    return rest.mapInArrow(run, schema)


def rate_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_tail: float = MIN_TAIL) -> DataFrame:
    """Fits on the labelled documents and rates all of them (see :func:`score`).

    Without usable labels every document has the same grade probabilities. Labels of unknown ids are not
    used; an id labelled several times counts with its lowest grade.
    """
    return score(docs, train(docs, labels, sample), min_tail)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return rate_documents(docs.select("doc_id", "text"), labels).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier selects, with their columns."""
    bare, columns = set_aside(docs, "doc_id", "text")
    return rate_documents(bare, labels).where("selected").select(*columns)
