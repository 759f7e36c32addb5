"""Operator 8: benchmark decontamination by BM25 retrieval with block-max WAND.

The test items are the indexed documents and every passage of every training document is a query. An item's BM25
score is divided by the score of a passage that holds the whole item, so one threshold serves items of any
length. Of an item of at most L words (L a power of two) any occurrence lies within a passage of 2 L words that
starts at a multiple of L; so items are indexed by length class, and a text is cut into overlapping passages of each class.

A passage first meets the sum of its terms' highest scores, as the first bound of WAND, for all passages of a text at
once, then the sums of the highest scores that its distinct terms have in any one run of neighbouring items. Passages
whose bounds reach the threshold go through block-max WAND over the posting lists, which returns every item at or
above the threshold. Retrieved items are verified: most word trigrams of their question and at least
half of those of their answer must occur in the passage.

Item statistics are Spark aggregates. Items are dealt to indexes of a bounded size, each of which all documents
pass once, without a shuffle. Ding and Suel, "Faster top-k document retrieval using block-max indexes", 2011.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilescope.llm.common import row_numbers, written_once

K1, B = 1.2, 0.75
#: Share of a whole item's score from which a passage retrieves it.
MIN_SCORE = 0.6
#: Shares of the question's and the answer's word trigrams that must occur in the passage.
MIN_QUESTION, MIN_ANSWER = 0.8, 0.5
#: UTF-8 bytes of items in one index.
INDEX_BYTES = 2 << 20
#: Postings of a block of block-max WAND.
BLOCK = 16
#: Runs of neighbouring items for which every term's highest score is tabled, at most.
RUNS = 64
#: Scores of terms by run that are summed at once.
BOUNDED = 1 << 20
CACHED_WORDS = 300_000
_EDGE = b".,;:!?\"'()[]{}<>#$%&*|~-_=+/\\"
OUTPUT = "item_id long, first_word long, score double, question_overlap double, answer_overlap double"


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cased words of any script, as UTF-8."""
    return text.lower().encode("utf-8", "replace").split() if text else []


def terms_of(text: str | None) -> list[bytes]:
    """Folded words without punctuation at their edges."""
    return [t for w in folded_words(text) if (t := w.strip(_EDGE))]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last line, of one line the last sentence, of one sentence the last quarter."""
    for parts in (text.strip().splitlines(), re.split(r"(?<=[.!?])\s+", text.strip())):
        parts = [p for x in parts if (p := terms_of(x))]
        if len(parts) > 1:
            return [w for p in parts[:-1] for w in p], parts[-1]
    words = terms_of(text)
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """Share of the distinct trigrams of ``part`` (shorter grams, if it has fewer words) in the passage; 1 if
    it has no words."""
    n = min(3, len(part))
    if not n:
        return 1.0
    wanted = set(zip(*(part[i:] for i in range(n)), strict=False))
    return len(wanted & set(zip(*(passage[i:] for i in range(n)), strict=False))) / len(wanted)


@dataclass
class Postings:
    """One term's items in ascending order with their scores, in blocks with their highest score."""

    items: list[int]
    scores: list[float]
    ends: list[int] = field(init=False)
    block_max: list[float] = field(init=False)
    highest: float = field(init=False)

    def __post_init__(self) -> None:
        blocks = range(0, len(self.items), BLOCK)
        self.ends = [self.items[min(i + BLOCK, len(self.items)) - 1] for i in blocks]
        self.block_max = [max(self.scores[i : i + BLOCK]) for i in blocks]
        self.highest = max(self.block_max)


class TextTerms:
    """The term numbers of a text, and for each place the last one before with the same term (-1 if none)."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.numbers = numbers

    @cached_property
    def before(self) -> np.ndarray:
        small = self.numbers.max(initial=0) < 1 << 16  # sorted by radix
        order = np.argsort(self.numbers.astype(np.uint16) if small else self.numbers, kind="stable")
        sorted_ = self.numbers[order]
        again = np.flatnonzero(sorted_[1:] == sorted_[:-1])
        found = np.full(len(order), -1, dtype=np.int64)
        found[order[again + 1]] = order[again]
        return found


class ClassIndex:
    """The items of one length class."""

    def __init__(self, length: int, vocabulary: int) -> None:
        self.length = length
        self.ceiling = np.zeros(vocabulary + 1, dtype=np.float64)  # the last place is for unknown words
        self.lists: dict[int, Postings] = {}
        self.raw: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.runs = np.zeros((vocabulary + 1, 1), dtype=np.float32)

    def close(self, items: int) -> None:
        run = max(1, -(-items // RUNS))
        self.runs = np.zeros((len(self.ceiling), -(-items // run)), dtype=np.float32)
        for term, pairs in self.raw.items():
            for item, score in pairs:
                self.runs[term, item // run] = max(self.runs[term, item // run], score)
        for term, pairs in self.raw.items():
            pairs.sort()
            self.lists[term] = found = Postings([i for i, _ in pairs], [s for _, s in pairs])
            self.ceiling[term] = found.highest
        self.raw.clear()

    def passages(self, text: TextTerms, least: float) -> Iterator[tuple[int, int]]:
        """Start and end of the passages whose distinct terms could together reach ``least`` in some run of items.

        Terms' highest scores are summed for all passages at once, at first with repeats, then without, then by runs.
        """
        terms, width = text.numbers, 2 * self.length
        total = np.concatenate([[0.0], self.ceiling[terms].cumsum()])
        starts = np.arange(0, max(1, len(terms) - self.length), self.length)
        ends = np.minimum(starts + width, len(terms))
        may = np.flatnonzero(total[ends] - total[starts] >= least - 1e-9)
        unknown = len(self.ceiling) - 1
        at_once = max(1, BOUNDED // (width * self.runs.shape[1]))
        for first in range(0, len(may), at_once):
            some = may[first : first + at_once]
            at = starts[some, None] + np.arange(width)
            inside = np.minimum(at, len(terms) - 1)
            fresh = (at < len(terms)) & (text.before[inside] < starts[some, None])
            distinct = np.where(fresh, terms[inside], unknown)
            good = self.ceiling[distinct].sum(1) >= least - 1e-9
            if good.any():
                good[good] = self.may_hold(distinct[good], least)
            for i in some[good]:
                yield int(starts[i]), int(ends[i])

    def may_hold(self, terms: np.ndarray, least: float) -> np.ndarray:
        """Whether the distinct terms' highest scores within any run of items add up to ``least``, for each row of terms."""
        return self.runs[terms].sum(-2).max(-1, initial=0) >= least - 1e-5

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """Every item with a score of at least ``least`` for the distinct terms: block-max WAND."""
        least -= 1e-9
        lists = [p for t in terms if (p := self.lists.get(t))]
        at = [0] * len(lists)
        found = []
        live = list(range(len(lists)))
        while live:
            live.sort(key=lambda c: lists[c].items[at[c]])
            bound, pivot = 0.0, -1
            for i, c in enumerate(live):
                bound += lists[c].highest
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]].items[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            bound, after = 0.0, None
            for c in live[: pivot + 1]:
                block = bisect.bisect_left(lists[c].ends, item)
                if block < len(lists[c].ends):
                    bound += lists[c].block_max[block]
                    after = lists[c].ends[block] + 1 if after is None else min(after, lists[c].ends[block] + 1)
            if bound >= least:
                if lists[live[0]].items[at[live[0]]] == item:
                    score = sum(lists[c].scores[at[c]] for c in live[: pivot + 1])
                    if score >= least:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:
                if pivot + 1 < len(live):
                    beyond = lists[live[pivot + 1]].items[at[live[pivot + 1]]]
                    after = beyond if after is None else min(after, beyond)
                target = max(item + 1, after or 0)
            for c in live[: pivot + 1]:
                if lists[c].items[at[c]] < target:
                    at[c] = bisect.bisect_left(lists[c].items, target, at[c])
            live = [c for c in live if at[c] < len(lists[c].items)]
        return found


class Terms(dict):
    """Raw word to term number; unknown words have the last number. A word of punctuation alone has -1."""

    def __init__(self, numbers: dict[bytes, int]) -> None:
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_EDGE)
        number = self.numbers.get(core, len(self.numbers)) if core else -1
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = number
        return number


@dataclass(frozen=True)
class Item:
    item_id: int | None
    question: list[bytes]
    answer: list[bytes]


class ItemIndex:
    """Items (item id, text, {term: share of the item's score}) by length class."""

    def __init__(self, items: list[tuple[int | None, str, dict[bytes, float]]]) -> None:
        self.numbers: dict[bytes, int] = {}
        for _, _, weights in items:
            for term in weights:
                self.numbers.setdefault(term, len(self.numbers))
        self.items: list[Item] = []
        self.classes: dict[int, ClassIndex] = {}
        for item_id, text, weights in items:
            length = 1 << max(3, (len(terms_of(text)) - 1).bit_length())
            by_class = self.classes.setdefault(length, ClassIndex(length, len(self.numbers)))
            for term, weight in weights.items():
                by_class.raw[self.numbers[term]].append((len(self.items), weight))
            self.items.append(Item(item_id, *question_and_answer(text)))
        for by_class in self.classes.values():
            by_class.close(len(self.items))

    def matches(self, text: str | None, terms: Terms, least: float) -> list[tuple[int | None, int, float, float, float]]:
        """The verified items of a text with their best passage."""
        numbers = np.fromiter(map(terms.__getitem__, words := folded_words(text)), dtype=np.int64, count=len(words))
        numbers = numbers[kept := numbers >= 0]
        best: dict[int, tuple] = {}
        spelled: list[bytes] | None = None
        found = TextTerms(numbers)
        for by_class in self.classes.values():
            for start, end in by_class.passages(found, least):
                known = np.unique(numbers[start:end])
                for i, score in by_class.retrieve(known.tolist(), least):
                    if spelled is None:
                        spelled = [words[j].strip(_EDGE) for j in np.flatnonzero(kept)]
                    item, passage = self.items[i], spelled[start:end]
                    question, answer = overlap(item.question, passage), overlap(item.answer, passage)
                    if question >= MIN_QUESTION and answer >= MIN_ANSWER:
                        row = (score, question, answer, -start)
                        best[i] = max(best.get(i, row), row)
        return [(self.items[i].item_id, -r[3], r[0], r[1], r[2]) for i, r in sorted(best.items())]


def _weighted_items(items: DataFrame) -> DataFrame:
    """Items with words, as (item_id, text, index, terms): each term's share of the item's own BM25 score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts: dict[bytes, int] = defaultdict(int)
                for term in terms_of(text.as_py()):
                    counts[term] += 1
                rows += [(number, term, n) for term, n in counts.items()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["number", "term", "times"]
            )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            numbers = pa.array(row_numbers(len(batch), made), pa.int64())
            made += len(batch)
            yield pa.RecordBatch.from_arrays([numbers, *batch.columns], ["number", *batch.schema.names])

    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    numbered = written_once(plain.mapInArrow(number, "number long, item_id long, text string"), "items")
    counted = written_once(numbered.select("number", "text").mapInArrow(run, "number long, term binary, times long"), "terms")
    lengths = counted.groupBy("number").agg(F.sum("times").alias("length"))
    whole = lengths.agg(F.count(F.lit(1)).alias("items"), F.avg("length").alias("average"))
    frequency = counted.groupBy("term").agg(F.count(F.lit(1)).alias("holders"))
    weight = F.expr(
        f"ln(1 + (items - holders + 0.5D) / (holders + 0.5D)) * times * {K1 + 1}D"
        f" / (times + {K1}D * (1 - {B}D + {B}D * length / average))"
    )
    terms = (
        counted.join(frequency, "term")
        .join(lengths, "number")
        .crossJoin(F.broadcast(whole))  # one row
        .select("number", F.struct("term", weight.alias("weight")).alias("pair"))
        .groupBy("number")
        .agg(F.collect_list("pair").alias("terms"))  # one item's terms
    )
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    sizes = numbered.select("number", F.sum(F.octet_length("text") + 1).over(before).alias("_end"))
    index = F.expr(f"cast(_end div {INDEX_BYTES} AS int)").alias("index")
    return numbered.join(terms, "number").join(sizes, "number").select("number", "item_id", "text", index, "terms")


def indexes(items: DataFrame) -> list[ItemIndex]:
    """Indexes of at most ``INDEX_BYTES`` of items each (or of one longer item), built one after the other."""
    weighted = written_once(_weighted_items(items), "weighted-items")
    built = []
    for (number,) in sorted(weighted.select("index").distinct().collect()):
        rows = weighted.where(F.col("index") == number).orderBy("number").collect()
        shares = [(r["item_id"], r["text"], {bytes(p["term"]): p["weight"] for p in r["terms"]}) for r in rows]
        built.append(ItemIndex([(i, t, {k: w / sum(ws.values()) for k, w in ws.items()}) for i, t, ws in shares]))
    return built


def find_leaks(docs: DataFrame, items: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """One row per document row and item found in it, with the item's best passage there.

    Columns: doc_id, item_id, first_word (place of the passage among the document's words), score (share of the
    item's own BM25 score), question_overlap, answer_overlap. Nulls: null or empty texts match nothing, as
    documents and as items; null ids are kept. Repeated documents and items give a row each; among passages that tie
    the first counts. Empty tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def over(index: ItemIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = Terms(index.numbers)
            for batch in batches:
                found = [
                    (doc_id.as_py(), *row)
                    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True)
                    for row in index.matches(text.as_py(), terms, least)
                ]
                columns = list(zip(*found, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                names = ["doc_id", *(c.split()[0] for c in OUTPUT.split(", "))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
                )

        return rows.mapInArrow(run, f"doc_id long, {OUTPUT}")

    found = None
    for index in indexes(items):
        found = over(index) if found is None else found.unionAll(over(index))
    if found is None:
        return rows.where("false").selectExpr(
            "doc_id", *(f"cast(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in OUTPUT.split(", "))
        )
    return found


def without_leaks(docs: DataFrame, items: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The documents in which no item is found, with their columns; each index filters what the last kept."""
    at = docs.columns.index("text")
    schema = docs.schema

    def keep(index: ItemIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = Terms(index.numbers)
            for batch in batches:
                clean = [not index.matches(t.as_py(), terms, least) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for index in indexes(items):
        docs = docs.mapInArrow(keep(index), schema)
    return docs


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the evidence."""
    return find_leaks(docs, benchmark).select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")
