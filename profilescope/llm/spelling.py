"""Operator 13: spelling variants by composing vocabulary acceptors with a one-edit transducer.

1. Words are counted within tasks, then summed; those frequent and long enough are the vocabulary.
2. The vocabulary is cut by initial states: prefixes with at most ``WORDS`` words below. Each such partition gets a
   minimised acceptor of its own, composed with the one-edit transducer and itself again (see ``automata.py``), and the
   accepted pairs are enumerated.
3. Pairs that differ before that, on an arc of one of the few initial states above the partitions, agree in all that
   follows the edit. These arcs are crossed by joins on the words without the character in that place.
4. A word's form is its most frequent neighbour, if frequent enough. Roots are found by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilescope.llm.automata import Acceptor, OneEdit
from profilescope.llm.common import written_once

#: Words below one initial state.
WORDS = 4096
#: Distinct words, and their characters, that a task counts before it hands them on.
COUNTED, CHARACTERS = 300_000, 16_000_000
MIN_LENGTH, MIN_TIMES = 5, 3
_RUN = re.compile("[a-z\u00C0-\u00FF]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")


def read_words(doc_id: int | None, text: str | None, misread: int) -> Iterator[tuple[str, int]]:
    """The runs of letters of a text and how often; a run loses a character if ``misread`` divides its checksum
    with the doc_id (a null id is written as an empty one). With ``misread`` 0 none does."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, times in Counter(_RUN.findall(lowered(text or ""))).items():
        if misread and not (check := zlib.crc32(word.encode(), before)) % misread:
            at = check % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, times


def vocabulary(docs: DataFrame, misread: int = 0, least: int = MIN_TIMES, length: int = MIN_LENGTH) -> DataFrame:
    """(word, n): words of at least ``length`` code points with at least ``least`` occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, characters = Counter(), 0

        def counted() -> Iterator[pa.RecordBatch]:
            rows = pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            for start in range(0, len(rows), 1 << 15):
                yield rows.slice(start, 1 << 15)

        for batch in batches:
            for number, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, times in read_words(number.as_py(), text.as_py(), misread):
                    if len(word) >= length:
                        characters += 0 if word in seen else len(word)
                        seen[word] += times
                if len(seen) >= COUNTED or characters >= CHARACTERS:
                    yield from counted()
                    seen, characters = Counter(), 0
        yield from counted()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _depths() -> Iterator[int]:
    """Prefix lengths, the next about half as long again."""
    depth = 1
    while True:
        yield depth
        depth += max(1, depth // 2)


def _partitioned(words: DataFrame) -> DataFrame:
    """The words with ``start``, the shortest tried prefix that at most ``WORDS`` of them have.

    A word whose prefixes all have more is its own start.
    """
    open_, done = words.withColumn("start", F.lit("")), None
    for depth in _depths():
        sized = open_.groupBy("start").agg(F.count("*").alias("_words"))
        crowded = written_once(sized.where(F.col("_words") > WORDS).select("start"), "crowded")
        if crowded.isEmpty():
            return open_ if done is None else done.unionAll(open_)
        settled = open_.join(crowded, "start", "left_anti").select("word", "n", "start")
        done = settled if done is None else done.unionAll(settled)
        below = open_.join(crowded, "start", "left_semi")
        open_ = written_once(below.select("word", "n", F.substring("word", 1, depth).alias("start")), "deeper")


def _accepted(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): pairs one edit apart with one start, which comes before the edit."""

    def pairs(start: str, group: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
        group.sort()
        acceptor = Acceptor([w[len(start) :] for w, _ in group])
        for i, j in OneEdit(acceptor).pairs():
            yield *group[i], *group[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, group, found = None, [], []
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch_of() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n", "other", "other_n"]
            )

        for batch in batches:
            for word, n, at in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "start")), strict=True):
                if at != start and group:
                    for pair in pairs(start, group):
                        found.append(pair)
                        if len(found) >= 1 << 15:
                            yield batch_of()
                            found = []
                    group = []
                start = at
                group.append((word, n))
        for pair in pairs(start, group) if group else ():
            found.append(pair)
            if len(found) >= 1 << 15:
                yield batch_of()
                found = []
        yield batch_of()

    met = words.select("word", "n", "start").repartition("start").sortWithinPartitions("start")
    return met.mapInArrow(run, "word string, n long, other string, other_n long")


def _above(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): pairs whose first difference lies within the start of both."""
    places = F.expr("explode(sequence(0, least(length(start), length(word)) - 1))")
    cuts = words.where("start <> ''").select("word", "n", places.alias("at"))
    rest = F.expr("concat(left(word, at), substring(word, at + 2))")
    # Of a run of one character, the last one is left out.
    last = F.expr("substring(word, at + 1, 1) <> substring(word, at + 2, 1)")
    cuts = written_once(cuts.select("word", "n", "at", rest.alias("rest"), last.alias("last")), "cuts")
    a = cuts.select("at", "rest", "word", "n")
    b = cuts.select("at", "rest", F.col("word").alias("other"), F.col("n").alias("other_n"))
    replaced = a.join(b, ["at", "rest"]).where("word < other").select("word", "n", "other", "other_n")
    whole = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    left_out = cuts.where("last").select("word", "n", F.col("rest").alias("other")).join(whole, "other")
    return replaced.unionAll(left_out.select("word", "n", "other", "other_n"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for every two of the words (word, n) that are one edit apart, each pair once.

    One edit inserts, deletes or replaces one code point. Words are distinct and not null.
    """
    parts = written_once(_partitioned(words.select("word", "n")), "partitions")
    return _accepted(parts).unionAll(_above(parts))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, by doubling."""
    known = written_once(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        stepped = known.join(onward, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), "_further")
        stepped = written_once(stepped, "roots")
        if stepped.where("_further IS NOT NULL").isEmpty():
            return stepped.drop("_further")
        known = stepped.drop("_further")


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words (word, n).

    A word's form is the most frequent of its near words (ties: the smallest in code-point order), if that has at least
    ``factor`` (over 1) times its occurrences; else null. The root is the last of its forms, the word itself without one.
    No words give no rows.
    """
    words = written_once(words.select("word", "n"), "vocabulary")
    pairs = written_once(near_words(words), "near-words")
    both = pairs.select("word", "other", "other_n").unionAll(
        pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("n"), "other"))
    met = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    frequent: Column = -F.col("_best.n") >= F.col("n") * factor
    found = words.join(met, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, F.col("_best.other")).alias("form"),
        F.when(frequent, -F.col("_best.n")).alias("form_n"),
    )
    found = written_once(found, "forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13(docs: DataFrame) -> DataFrame:
    """The contract. Null and empty texts and texts without letters have no words; a null doc_id is written as an empty
    one in the checksum; repeated rows count again; an empty table gives no rows; other columns are not read."""
    return variants(vocabulary(docs, misread=97))


#: The checksum is CRC-32 (reflected polynomial 0xEDB88320) by a table; letters of two UTF-8 bytes start with 195.
ORACLE_OP13 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(concat(doc_id, ':', run), ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))::BIGINT[]),
    lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]))) AS h
  FROM counted, crc
), spelled AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM summed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (
  SELECT word, n, unnest(range(length(word))) AS i FROM words
), cuts AS (
  SELECT word, n, i, word[: i] || word[i + 2 :] AS rest FROM places
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cuts.word, w.word, w.n FROM cuts JOIN words w ON w.word = rest
  UNION SELECT w.word, cuts.word, cuts.n FROM cuts JOIN words w ON w.word = rest
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
    CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = chain.root WHERE form IS NOT NULL
)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain ON chain.word = f.word JOIN forms last ON last.word = chain.root WHERE last.form IS NULL
"""
