"""Operator 4: documents scored by a gated recurrent language model that is trained on the corpus.

1. Words of all training documents are counted (combined per task before the shuffle) into a vocabulary table.
2. The ``OUTPUTS`` most frequent words are tokens of their own. Every other word belongs to one of ``RARE`` rare
   tokens, chosen by its first three bytes, and has an add-one share of it that also covers unseen words; so
   the model gives every word a probability, and those of all words add up to one.
3. The network (see ``recurrent.py``) starts at the corpus frequencies and learns from all training documents, each
   once, by local descent: in every round each worker passes over its share of a part of the documents and the
   weights are averaged, in pieces, by a grouped aggregation.
4. All documents are scored whole, each state carried from window to window. A worker holds the counts of at
   most ``HEAD`` frequent words; those of all other words are joined from the vocabulary table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilescope.llm.common import row_numbers, words_of, written_once
from profilescope.llm.recurrent import GatedModel

#: The end of a document; no word contains white space.
END = b"\n"
OUTPUTS, RARE = 2048, 64
#: Words whose counts every worker holds, at most: some 25 MB.
HEAD = 200_000
#: Parts of the training documents; a round of training learns from one, and together they learn from all.
PARTS = 8
#: Tokens that a worker learns from at least in a round, and those that it lays out at once.
LEAST_TOKENS, LAID_OUT = 200_000, 1_000_000
#: Words that a task counts before it hands them on.
COUNTED = 400_000
_PIECES = 16
_LN10 = float(np.log(10))


def rare_token(word: bytes) -> int:
    return zlib.crc32(word[:3]) % RARE


def held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out): held out are ids whose text's CRC-32 leaves 2 by 7; a null id is not."""
    doc_id = F.col("doc_id").cast("long")
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 7
    return docs.select(
        doc_id.alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(rest == 2, F.lit(False)).alias("held_out"),
    )


def count_words(docs: DataFrame) -> DataFrame:
    """(word, times) of the training documents, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                counts[END] += 1
                if len(counts) >= COUNTED:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    rows = docs.where("NOT held_out").select("text").mapInArrow(run, "word binary, times long")
    return written_once(rows.groupBy("word").agg(F.sum("times").alias("times")), "vocabulary")


def _counted(counts: Counter[bytes]) -> pa.RecordBatch:
    columns = [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["word", "times"])


class Codes(dict):
    """Word to its place among the frequent words; any other word gives -1 minus its rare token."""

    def __missing__(self, word: bytes) -> int:
        return -1 - rare_token(word)


@dataclass
class Vocabulary:
    """What a worker needs of the vocabulary: frequent words by falling count, and totals."""

    words: list[bytes]
    times: np.ndarray
    tokens: int  # all training tokens
    distinct: int
    rare_times: np.ndarray  # of each rare token: tokens, and distinct words
    rare_words: np.ndarray
    least: int  # words that are held by no worker occur this often at most

    def __post_init__(self) -> None:
        own = min(OUTPUTS, len(self.words))
        shares = np.concatenate([self.times[:own], self.rare_times]) + 1.0
        order = np.argsort(-shares, kind="stable")
        self.shares = shares[order] / shares.sum()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.rare_place = place[own:]
        rare = np.array([rare_token(w) for w in self.words[own:]], dtype=np.int64)
        self.place = np.concatenate([place[:own], self.rare_place[rare]])
        self.log_times = np.log10(self.times + 1.0)
        self.log_rare = np.log10(self.rare_times + self.rare_words + 1.0)
        self.inside = np.concatenate([np.zeros(own), self.log_times[own:] - self.log_rare[rare]])

    def codes(self) -> Codes:
        return Codes(zip(self.words, range(len(self.words)), strict=True))

    def encode(self, text: str | None, codes: Codes) -> tuple[list[bytes], np.ndarray]:
        """The text's words with its end, and their codes."""
        words = words_of(text)
        words.append(END)
        return words, np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))

    def outputs(self, codes: np.ndarray) -> np.ndarray:
        """Codes as the network's tokens."""
        frequent = codes >= 0
        found = self.rare_place[np.where(frequent, 0, -1 - codes)]
        found[frequent] = self.place[codes[frequent]]
        return found


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded part of the vocabulary table: every word above the least count that leaves at most ``HEAD``."""
    level = F.expr("CASE WHEN times < 256 THEN times ELSE 256 + cast(floor(log2(times / 256.0D) * 32) AS bigint) END")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.max("times").alias("most"))
    above = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # some two thousand levels
    left_out = levels.withColumn("held", F.sum("words").over(above)).where(F.col("held") > HEAD)
    least = left_out.agg(F.max("most")).first()[0] or 0
    rows = counts.where(F.col("times") > least).toArrow()
    words, times = rows.column("word").to_pylist(), rows.column("times").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-times[i], words[i]))
    words, times = [words[i] for i in order], np.array([times[i] for i in order], dtype=np.int64)
    rare = F.pmod(F.crc32(F.substring("word", 1, 3)), F.lit(RARE)).cast("int")
    totals = counts.groupBy(rare.alias("rare")).agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("words"))
    rare_times, rare_words = np.zeros(RARE, dtype=np.int64), np.zeros(RARE, dtype=np.int64)
    for row in totals.collect():
        rare_times[row["rare"]], rare_words[row["rare"]] = row["times"], row["words"]
    tokens, distinct = int(rare_times.sum()), int(rare_words.sum())
    for word, n in zip(words[:OUTPUTS], times[:OUTPUTS], strict=True):
        rare_times[rare_token(word)] -= n
        rare_words[rare_token(word)] -= 1
    return Vocabulary(words, times, tokens, distinct, rare_times, rare_words, int(least))


def train(docs: DataFrame, known: Vocabulary, parts: int = PARTS) -> np.ndarray:
    """The network's parameters after averaged local descent over all training documents, one of ``parts`` a round."""
    model = GatedModel(known.shares)
    parameters = model.parameters()
    expected = known.tokens // parts
    workers = max(1, min(docs.sparkSession.sparkContext.defaultParallelism, expected // LEAST_TOKENS))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    for number in range(parts):
        chosen = docs.where(~F.col("held_out") & (part == number)).select("text").repartition(workers)
        run = _learner(known, parameters)
        pieces = chosen.mapInArrow(run, "piece int, tokens long, weights binary")
        mean = pieces.groupBy("piece").applyInPandas(_mean, "piece int, weights binary").orderBy("piece").collect()
        if mean:
            parameters = np.concatenate([np.frombuffer(r["weights"], dtype=np.float32) for r in mean])
    return parameters


def _learner(known: Vocabulary, parameters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, model = known.codes(), GatedModel(known.shares).load(parameters)
        laid_out: list[np.ndarray] = []
        tokens = waiting = 0
        for batch in batches:
            for text in batch.column(0):
                laid_out.append(known.outputs(known.encode(text.as_py(), codes)[1]))
                waiting += len(laid_out[-1])
                if waiting >= LAID_OUT:
                    tokens += model.train(laid_out)
                    laid_out, waiting = [], 0
        tokens += model.train(laid_out)
        if tokens:
            parts = [p.astype(np.float32).tobytes() for p in np.array_split(model.parameters(), _PIECES)]
            columns = [pa.array(range(_PIECES), pa.int32()), pa.array([tokens] * _PIECES, pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "tokens", "weights"])

    return run


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    """The workers' weights, averaged by their tokens."""
    rows = rows.sort_values(["tokens", "weights"])
    total = sum(
        np.frombuffer(w, dtype=np.float32).astype(float) * n for w, n in zip(rows["weights"], rows["tokens"], strict=True)
    )
    mean = (total / rows["tokens"].sum()).astype(np.float32).tobytes()
    return pd.DataFrame({"piece": rows["piece"].iloc[:1].to_numpy(), "weights": [mean]})


_PARTS = [
    ("doc_id", "long", pa.int64()),
    ("held_out", "boolean", pa.bool_()),
    ("_row", "long", pa.int64()),
    ("n_tokens", "long", pa.int64()),
    ("_known", "long", pa.int64()),
    ("_base", "double", pa.float64()),
    ("_score", "double", pa.float64()),
    ("_words", "array<binary>", pa.list_(pa.binary())),
    ("_times", "array<int>", pa.list_(pa.int32())),
]


def _scored(docs: DataFrame, known: Vocabulary, parameters: np.ndarray) -> DataFrame:
    """Each document's figures without its words of the vocabulary table, and those words."""
    everywhere = float(np.log10(known.tokens + known.distinct + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, model, made = known.codes(), GatedModel(known.shares).load(parameters), 0
        for batch in batches:
            n = len(batch)
            figures, tails, tokens = np.zeros((n, 2)), [], []
            for i, text in enumerate(batch.column(1)):
                words, found = known.encode(text.as_py(), codes)
                frequent = found[found >= 0]
                rare = found[found < 0]
                tails.append(Counter(words[j] for j in np.flatnonzero(found < 0)))
                figures[i] = (
                    known.log_times[frequent].sum() - len(found) * everywhere,
                    known.inside[frequent].sum() - known.log_rare[-1 - rare].sum(),
                )
                tokens.append(known.outputs(found).astype(np.int32))
            lengths = np.array([len(t) for t in tokens], dtype=np.int64)
            missing = np.array([sum(t.values()) for t in tails], dtype=np.int64)
            figures[:, 1] += model.score(tokens) / _LN10
            columns = [
                batch.column(0),
                batch.column(2),
                row_numbers(n, made),
                lengths,
                lengths - missing,
                figures[:, 0],
                figures[:, 1],
                [list(t) for t in tails],
                [list(t.values()) for t in tails],
            ]
            made += n
            arrays = [
                c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, _, kind) in zip(columns, _PARTS, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(arrays, [name for name, _, _ in _PARTS])

    schema = ", ".join(f"{name} {kind}" for name, kind, _ in _PARTS)
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """All documents with doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Scores are base-10 logarithms of the probability of the whole text with its end: ``base_score`` by add-one
    word frequencies, ``score`` by the recurrent model. Nulls: a null text is empty, its end alone; a null
    doc_id is not held out. Repeated rows are counted and scored each. Without training documents the words
    are unknown and the network is untrained. An empty table gives no rows. Other columns are not read.
    """
    rows = held_out(docs)
    counts = count_words(rows)
    known = vocabulary(counts)
    scored = written_once(_scored(rows, known, train(rows, known)), "scored")
    tails = scored.select("_row", F.explode(F.arrays_zip(F.col("_words").alias("word"), F.col("_times").alias("n"))).alias("t"))
    tails = tails.select("_row", F.col("t.word").alias("word"), F.col("t.n").cast("long").alias("n"))
    seen = tails.join(counts.where(F.col("times") <= known.least), "word")
    logs = F.sum(F.col("n") * F.log10(F.col("times") + 1.0))
    more = seen.groupBy("_row").agg(F.sum("n").alias("_seen"), logs.alias("_logs"))
    logs = F.coalesce("_logs", F.lit(0.0))
    return (
        scored.drop("_words", "_times")
        .join(more, "_row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("_known") + F.coalesce("_seen", F.lit(0))).alias("n_known"),
            F.lit(known.tokens).cast("long").alias("train_tokens"),
            (F.col("_base") + logs).alias("base_score"),
            (F.col("_score") + logs).alias("score"),
        )
    )


def op4(docs: DataFrame) -> DataFrame:
    return score_documents(docs)
