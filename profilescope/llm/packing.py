"""Operator 10: sum-of-squares packing of tokenized documents into training sequences.

Each task packs the documents of its partition as they come. A level array counts the partially filled
windows by fill level; a document goes to the level whose change keeps the sum of squared counts smallest
(Csirik et al., "On the sum-of-squares algorithm for bin packing", 2006). Documents of a window's length or
more first give up full windows; only the rest is placed. Nothing is shuffled, and a task holds the token ids
of at most ``max_open`` windows and one document.

When more windows are open than that, or the partition ends, what is in open windows is cut anew into full
sequences. At the end the last tokens become sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilescope.llm.common import row_numbers
from profilescope.llm.encoding import CACHED_PARTS, DEFAULT_TOKENIZER, encoder

CAPACITY = 4096
END_ID = 2
MAX_OPEN = 256
OUTPUT = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Pieces handed to Spark at once, and bytes of their ids.
BATCH, BATCH_BYTES = 2048, 4 << 20


@dataclass(frozen=True, slots=True)
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) >> 2

    def cut(self, first: int, length: int) -> Piece:
        return Piece(self.doc_id, self.start + first, self.ids[4 * first : 4 * (first + length)], self.doc_tokens)


class SquaresPacker:
    """Online packing of pieces shorter than ``capacity``; full windows are returned as they fill."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN) -> None:
        self.capacity = capacity
        self.max_open = max(1, max_open)
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.windows: dict[int, list[list[Piece]]] = defaultdict(list)
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level to place ``size`` tokens on; 0 opens a window. Ties go to the fullest level."""
        below = self.levels[1 : self.capacity - size + 1]
        change = np.where(below > 0, 2 * (self.levels[1 + size :] - below) + 2, np.iinfo(np.int64).max)
        if len(change) == 0:
            return 0
        if below[-1] > 0:
            change[-1] -= 1  # a full window leaves the sum
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * self.levels[size] + 1 and below[best] > 0 else 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        size = len(piece)
        level = self.level_for(size)
        window = []
        if level:
            window = self.windows[level].pop()
            self.levels[level] -= 1
            self.open -= 1
        window.append(piece)
        if level + size == self.capacity:
            yield window
            return
        self._keep(level + size, window)
        if self.open > self.max_open:
            yield from self._cut_anew()

    def _keep(self, level: int, window: list[Piece]) -> None:
        self.windows[level].append(window)
        self.levels[level] += 1
        self.open += 1

    def _cut_anew(self) -> Iterator[list[Piece]]:
        """Everything in open windows as full sequences; the rest stays open as one window."""
        left = [p for level in sorted(self.windows, reverse=True) for w in self.windows[level] for p in w]
        self.windows.clear()
        self.levels[:] = 0
        self.open = 0
        window: list[Piece] = []
        room = self.capacity
        for piece in left:
            done = 0
            while done < len(piece):
                part = piece.cut(done, min(room, len(piece) - done))
                window.append(part)
                done += len(part)
                room -= len(part)
                if not room:
                    yield window
                    window, room = [], self.capacity
        if window:
            self._keep(self.capacity - room, window)

    def finish(self) -> Iterator[list[Piece]]:
        """The last sequences: full ones, then one for each binary digit of what is left."""
        yield from self._cut_anew()
        left = [p for windows in self.windows.values() for w in windows for p in w]
        rest = sum(map(len, left))
        self.__init__(self.capacity, self.max_open)
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            window = []
            while room:
                part = left[0].cut(0, min(room, len(left[0])))
                left[0] = left[0].cut(len(part), len(left[0]) - len(part))
                if not len(left[0]):
                    left.pop(0)
                window.append(part)
                room -= len(part)
            yield window


def pack(
    docs: DataFrame,
    tokenizer: str = DEFAULT_TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    max_open: int = MAX_OPEN,
    cached_parts: int = CACHED_PARTS,
) -> DataFrame:
    """Documents (``doc_id``, ``text``) as pieces of sequences of at most ``capacity`` tokens.

    A document is its ids and then ``end_id``. Returns one row per piece: doc_id, start (ids of its document
    before it), ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (in its sequence).
    ``cached_parts`` trades a worker's memory for time and changes no row.

    Nulls: a null or empty text is the end id alone; a null doc_id stays null, its pieces are packed. Repeated
    rows and ids are packed each. An empty table gives no rows. Other columns are not read. A text of any
    length is tokenized whole; its full windows leave at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cached_parts).encode
        end = end_id.to_bytes(4, "little")
        packer = SquaresPacker(capacity, max_open)

        def windows() -> Iterator[list[Piece]]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = encode(text.as_py()) + end
                    whole = Piece(doc_id.as_py(), 0, ids, len(ids) >> 2)
                    full = len(whole) // capacity * capacity
                    for i in range(0, full, capacity):
                        yield [whole.cut(i, capacity)]
                    if full < len(whole):
                        yield from packer.add(whole.cut(full, len(whole) - full))
            yield from packer.finish()

        rows: list[tuple] = []
        held = 0
        for made, window in enumerate(windows()):
            (number,) = row_numbers(1, made)
            offset = 0
            for p in window:
                rows.append((p.doc_id, p.start, p.ids, p.doc_tokens, number, offset))
                offset += len(p)
                held += len(p.ids)
            if len(rows) >= BATCH or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUTPUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)


def op10(docs: DataFrame) -> DataFrame:
    """The contract's row per piece: the ids as length and CRC-32."""
    return pack(docs).select(
        "doc_id",
        "start",
        F.expr("cast(octet_length(ids) div 4 AS bigint)").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
