"""Operator 12: a Jaccard join of shingle sets by vertical partitioning of the global shingle order.

1. One pass gives each text's shingle set a digest; documents with equal sets are one class.
2. The shingles of all sets meet once, in ranges of their hashes. What only one set holds (its own shingles) can add to no
   overlap and goes; the rest gets a place in the global order: few holders first, frequent shingles last.
3. Two sets of the similarity share one of their first n - ceil(similarity * n) + 1 shingles in that order. Classes whose
   own shingles fill these places have no partner. The others meet in a bucket for each shingle of these places.
4. In each bucket all classes are paired with its centre, the class with the smallest share of own shingles. Bounds
   from sizes, own shingles and a parity sketch of the rest drop pairs that can't have the similarity.
5. The order is cut at pivots into fragments, and sets into one segment for each fragment. Overlaps of a pair are counted
   for each fragment apart and summed per pair; that sum is exact and decides.
6. Components of the links. In buckets that still hold several components, classes outside the centre's component
   are compared with all others under the same bounds, in blocks; what passes is counted as before.

J. Rong et al., "Fast and scalable distributed set similarity joins for big data analytics", 2017.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilescope.llm.common import row_numbers, written_once
from profilescope.llm.components import components
from profilescope.llm.sketching import Shingler

WIDTH, SIMILARITY = 5, 80  # words, per cent
#: Shingles that a task lays side by side, holders among them from which a shingle goes past the buckets, and to how many
#: partitions those of one task go.
BUFFERED, FREQUENT, SPREAD = 1 << 20, 8, 64
#: Shingles of a bucket.
BUCKET = 1 << 22
#: Sets that a task remembers having sent; forgetting them only costs a repetition.
REMEMBERED = 200_000
#: The last place in the global order.
LAST = (1 << 31) - 1
FRAGMENTS = 16
#: Sketches are 16 words of 64 bits.
SKETCH = 16
#: Classes on either side of a block of comparisons.
BLOCK = 1024


def _digested(shingler: Shingler, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, bytes]]:
    for text in batch.column(0):
        found = shingler.shingles(text.as_py())
        yield found, hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)


def _sets(docs: DataFrame, width: int, carried: Sequence[str]) -> DataFrame:
    """``_document``, a struct of doc_id and the carried columns, with the size of its set and the two halves of the set's digest."""
    own = F.col("doc_id").cast("long").alias("_id")
    fields = F.struct(own, F.struct(*(F.col(f"`{c}`") for c in carried)).alias("columns"))
    rows = docs.select(F.col("text").cast("string").alias("text"), fields.alias("_document"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            found = [(len(s), d) for s, d in _digested(shingler, batch)]
            halves = _halves([d for _, d in found])
            more = [pa.array([n for n, _ in found], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column(1), *more], ["_document", "_size", "_high", "_low"])

    schema = rows.select("_document").schema.add("_size", "long").add("_high", "long").add("_low", "long")
    return rows.mapInArrow(run, schema)


def _laid_out(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """The shingles of all texts by buckets, which are ranges of shingle hashes, a row for each bucket of a lay.

    A lay is what a task holds at a time: the sets of some texts, repeats left out. ``at`` says to which of them
    each shingle belongs. Shingles that many of a lay hold are in several sets for sure. They go past the buckets in a row of
    the lay, with a bucket below 0, that also has the sets' sizes and digests; the buckets are only told (``marked``).
    """
    limits = np.array([-(-i * 2**64 // buckets) for i in range(1, buckets)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sent, buffered, waiting, made = Shingler(width), set(), [], 0, 0
        kinds = [pa.int32(), pa.int64(), *(pa.list_(x) for x in (pa.int32(), *[pa.int64()] * 2, pa.int32(), *[pa.int64()] * 2))]
        names = ["bucket", "lay", "at", "token", "marked", "size", "high", "low"]

        def laid() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s, _ in buffered], dtype=np.int32)
            halves = _halves([d for _, d in buffered])
            token = np.concatenate([s for s, _ in buffered])
            at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            known, place, held = np.unique(token, return_inverse=True, return_counts=True)
            hot, marks = held[place] >= FREQUENT, known[held >= FREQUENT]
            lay = row_numbers(1, made)[0]
            rows = [(-1 - made % SPREAD, lay, at[hot], token[hot].view(np.int64), [], sizes, halves[:, 0], halves[:, 1])]
            # Set by set within each bucket, which compresses well.
            token, at = token[~hot], at[~hot]
            bucket_of = np.searchsorted(limits, token, side="right")
            order = np.argsort(bucket_of, kind="stable")
            token, at, bucket_of = token[order], at[order], bucket_of[order]
            marked = np.searchsorted(limits, marks, side="right")
            for bucket in np.unique(np.concatenate([bucket_of, marked])).tolist():
                begun, end = np.searchsorted(bucket_of, [bucket, bucket + 1])
                told = marks[slice(*np.searchsorted(marked, [bucket, bucket + 1]))].view(np.int64)
                rows.append((bucket, lay, at[begun:end], token[begun:end].view(np.int64), told, [], [], []))
            for start in range(0, len(rows), 256):
                columns = zip(*rows[start : start + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for found, digest in _digested(shingler, batch):
                if not len(found) or digest in sent:
                    continue
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(digest)
                buffered.append((found, digest))
                waiting += len(found)
                if waiting >= BUFFERED:
                    yield from laid()
                    made += 1
                    buffered, waiting = [], 0
        if buffered:
            yield from laid()

    schema = (
        "bucket int, lay long, at array<int>, token array<long>, marked array<long>, "
        "size array<int>, high array<long>, low array<long>"
    )
    return docs.select("text").mapInArrow(run, schema)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column without nulls."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _ordered(laid: DataFrame) -> DataFrame:
    """The shingles that several sets hold, with their ``place`` in the global order: the number of holders, or ``LAST`` where
    a lay had many. Ties are broken by the shingle. Rows are of a lay again, some for each."""
    kinds = [pa.int64(), *(pa.list_(x) for x in (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
    names = ["lay", "at", "token", "place", "size", "high", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lays, ats, tokens, marks = -1, [], [], [], []

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        def placed() -> Iterator[pa.RecordBatch]:
            lay = np.repeat(np.array(lays), [len(x) for x in ats])
            at, token, marked = np.concatenate(ats), np.concatenate(tokens), np.unique(np.concatenate(marks))
            if not len(token):
                return
            order = np.argsort(token, kind="stable")
            lay, at, token = lay[order], at[order], token[order]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            holders = np.diff(np.concatenate([starts, [len(token)]]))
            place = np.where(np.isin(token[starts], marked, assume_unique=True), LAST, holders)
            place = np.repeat(place, holders).astype(np.int32)
            keep = np.flatnonzero(place > 1)
            keep = keep[np.lexsort((at[keep], lay[keep]))]
            lay, at, token, place = (x[keep] for x in (lay, at, token, place))
            starts = np.flatnonzero(np.concatenate([[True], lay[1:] != lay[:-1]])) if len(lay) else []
            rows = [
                (lay[a], at[a:b], token[a:b], place[a:b], [], [], [])
                for a, b in zip(starts, [*starts[1:], len(lay)], strict=True)
            ]
            for start in range(0, len(rows), 256):
                yield rows_of(rows[start : start + 256])

        for batch in batches:
            lists = {c: _lists(batch.column(c)) for c in ("at", "token", "marked", "size", "high", "low")}
            numbers, buckets = batch.column("lay").to_pylist(), batch.column("bucket").to_pylist()
            for i, (lay, bucket) in enumerate(zip(numbers, buckets, strict=True)):
                if bucket < 0:
                    last = np.full(len(lists["at"][i]), LAST, dtype=np.int32)
                    yield rows_of([(lay, lists["at"][i], lists["token"][i], last, *(lists[c][i] for c in ("size", "high", "low")))])
                    continue
                if bucket != current and lays:
                    yield from placed()
                    lays, ats, tokens, marks = [], [], [], []
                current = bucket
                lays.append(lay), ats.append(lists["at"][i]), tokens.append(lists["token"][i]), marks.append(lists["marked"][i])
        if lays:
            yield from placed()

    met = laid.repartition("bucket").sortWithinPartitions("bucket")
    schema = "lay long, at array<int>, token array<long>, place array<int>, size array<int>, high array<long>, low array<long>"
    return met.mapInArrow(run, schema)


def _first(size: int, similarity: int) -> int:
    """How many of a set's first shingles hold one of any similar set."""
    return size - -(-similarity * size // 100) + 1


def _parities(tokens: np.ndarray) -> np.ndarray:
    """1,024 bits, each the parity of the shingles that fall on it: where the sketches of two sets differ, the sets do."""
    odd = np.bincount((tokens.view(np.uint64) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _classes(ordered: DataFrame, similarity: int) -> DataFrame:
    """(class, high, low, size, own, first, tokens, places, sketch) of the sets that may have a partner; repeats are left.

    ``tokens`` are the shingles that others hold too, in the global order, ``first`` says how many of them make buckets.
    """
    schema = (
        "class long, high long, low long, size long, own long, first int, "
        "tokens array<long>, places array<int>, sketch array<long>"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [*[pa.int64()] * 5, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, current, parts, facts = 0, None, [], None

        def complete() -> pa.RecordBatch | None:
            nonlocal made
            at, token, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((token, place, at))
            at, token, place = at[order], token[order], place[order]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
            found = []
            for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
                size, high, low = (int(x[at[a]]) for x in facts)
                own = size - (b - a)
                first = _first(size, similarity) - own
                if first > 0:
                    found.append((high, low, size, own, first, token[a:b], place[a:b], _parities(token[a:b])))
            if not found:
                return None
            numbers = row_numbers(len(found), made)
            made += len(found)
            columns = [numbers, *zip(*found, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            lists = {c: _lists(batch.column(c)) for c in ("at", "token", "place", "size", "high", "low")}
            for i, lay in enumerate(batch.column("lay").to_pylist()):
                if lay != current and parts:
                    if (done := complete()) is not None:
                        yield done
                    parts, facts = [], None
                current = lay
                parts.append((lists["at"][i], lists["token"][i], lists["place"][i]))
                if len(lists["size"][i]):
                    facts = [lists[c][i] for c in ("size", "high", "low")]
        if parts and (done := complete()) is not None:
            yield done

    return ordered.repartition("lay").sortWithinPartitions("lay").mapInArrow(run, schema)


def _segments(classes: DataFrame, fragments: int) -> DataFrame:
    """(class, fragment, tokens): each set cut where the global order is cut into fragments of about equal weight."""
    position = F.expr("place + (shiftrightunsigned(token, 11) / 9007199254740992D)")  # 2^53
    shares = [i / fragments for i in range(1, fragments)]
    every = classes.select(F.explode(F.arrays_zip(F.col("tokens").alias("token"), F.col("places").alias("place"))).alias("x"))
    cuts = every.select("x.*").agg(F.percentile_approx(position, shares, 1000).alias("cuts")).first()["cuts"]
    pivots = np.unique(np.array(cuts or [], dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, parts = [], [], []
            for number, tokens, places in zip(*(batch.column(c) for c in ("class", "tokens", "places")), strict=True):
                token = tokens.values.to_numpy()
                at = places.values.to_numpy() + (token.view(np.uint64) >> np.uint64(11)) / 2.0**53
                part = np.searchsorted(pivots, at, side="right")
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                for a, b in zip(starts, [*starts[1:], len(token)], strict=True):
                    ids.append(number.as_py()), numbers.append(int(part[a])), parts.append(token[a:b])
            arrays = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["class", "fragment", "tokens"])

    return classes.select("class", "tokens", "places").mapInArrow(run, "class long, fragment int, tokens array<long>")


def _may_link(a: str, b: str, similarity: int, sketched: bool) -> Column:
    """Whether sizes, own shingles and sketches of two classes allow the similarity.

    Own shingles of either and unequal numbers or parities of the others are differences; similar sets have
    at most (100 - similarity) / (100 + similarity) of their sizes' sum.
    """
    shared = lambda x: F.col(f"{x}.size") - F.col(f"{x}.own")
    unlike = F.abs(shared(a) - shared(b))
    if sketched:
        bits = [F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])).cast("long") for i in range(SKETCH)]
        unlike = F.greatest(unlike, sum(bits[1:], bits[0]))
    differing = F.col(f"{a}.own") + F.col(f"{b}.own") + unlike
    return differing * (100 + similarity) <= (F.col(f"{a}.size") + F.col(f"{b}.size")) * (100 - similarity)


def _counted(pairs: DataFrame, segments: DataFrame, facts: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v) that are similar: overlaps counted for each fragment, summed per pair."""
    left = segments.select(F.col("class").alias("u"), "fragment", F.col("tokens").alias("a"))
    right = segments.select(F.col("class").alias("v"), "fragment", F.col("tokens").alias("b"))
    partial = pairs.join(left, "u").join(right, ["v", "fragment"]).select(
        "u", "v", F.size(F.array_intersect("a", "b")).cast("long").alias("overlap")
    )
    summed = partial.groupBy("u", "v").agg(F.sum("overlap").alias("overlap"))
    sizes = lambda x: facts.select(F.col("class").alias(x), F.col("size").alias(f"{x}_size"))
    both = summed.join(sizes("u"), "u").join(sizes("v"), "v")
    union = F.col("u_size") + F.col("v_size") - F.col("overlap")
    return both.where(F.col("overlap") * 100 >= union * similarity).select("u", "v")


def _about_centres(buckets: DataFrame, facts: DataFrame, similarity: int) -> DataFrame:
    """Distinct pairs (u, v) of a class and the centre of a bucket, as far as the bounds allow a link."""
    sized = facts.select("class", "size", "own")
    bare = buckets.join(sized.withColumnsRenamed({"class": "centre"}), "centre")
    pairs = bare.where("class <> centre").select("class", F.struct("centre", "size", "own").alias("c")).join(sized, "class")
    pairs = pairs.select(F.struct("class", "size", "own").alias("x"), "c")
    pairs = pairs.where(_may_link("x", "c", similarity, False)).select(F.col("x.class").alias("u"), F.col("c.centre").alias("v"))
    whole = F.struct("class", "size", "own", "sketch")
    x, c = (facts.select(F.col("class").alias(n), whole.alias(f"{n}_facts")) for n in ("u", "v"))
    joined = pairs.distinct().join(x, "u").join(c, "v")
    return joined.where(_may_link("u_facts", "v_facts", similarity, True)).select("u", "v")


def _across(buckets: DataFrame, facts: DataFrame, roots: DataFrame, similarity: int) -> DataFrame:
    """Distinct pairs (u, v) of classes of one bucket but different components that the bounds allow to be linked.

    Only classes outside the component of the bucket's centre look for partners, among all classes of the
    bucket, in blocks of about ``BLOCK`` by ``BLOCK``.
    """
    known = roots.withColumnRenamed("node", "class")
    rows = buckets.join(known, "class", "left").withColumn("root", F.coalesce("root", "class"))
    main = F.max(F.when(F.col("class") == F.col("centre"), F.col("root"))).alias("main")
    state = rows.groupBy("token").agg(main, F.min("root").alias("_a"), F.max("root").alias("_z"), F.count("*").alias("members"))
    open_ = rows.join(state.where("_a <> _z").select("token", "main", "members"), "token")
    open_ = written_once(open_.select("token", "class", "root", "main", "members"), "open-buckets")
    strays = open_.where("root <> main").groupBy("token").agg(F.count("*").alias("strays"))
    open_ = open_.join(strays, "token").join(facts, "class")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("class"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    whole = F.struct("class", "root", "size", "own", "sketch")
    x = open_.where("root <> main").select("token", mine("strays").alias("i"), every("members").alias("j"), whole.alias("x"))
    y = open_.select("token", every("strays").alias("i"), mine("members").alias("j"), whole.alias("y"))
    met = x.join(y.hint("merge"), ["token", "i", "j"]).where(F.col("x.root") != F.col("y.root"))
    pairs = met.where(_may_link("x", "y", similarity, True)).select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def joined(
    docs: DataFrame,
    width: int = WIDTH,
    similarity: int = SIMILARITY,
    fragments: int = FRAGMENTS,
    carried: Sequence[str] | None = None,
) -> DataFrame:
    """All documents, with the ``carried`` columns (all, if not told), ``n_shingles`` and ``component_id``.

    Linked are documents whose sets of distinct ``width``-word shingles have 100 * intersection >= similarity * union
    (similarity from 1 to 100). component_id is the smallest doc_id reachable by links. Texts without words (null,
    empty, white space) have no shingles and are linked with nothing: their id is their component's. Texts with fewer
    words are one shingle. A null doc_id takes part and loses to any other id; a component of null ids alone has a
    null id. Repeated rows have equal sets and link. An empty table gives no rows. Columns with the names
    of the two results are replaced; other names are free. Shingles are compared by 64-bit hashes, sets by 128 bits.
    """
    names = [c for c in (docs.columns if carried is None else carried) if c not in ("n_shingles", "component_id")]
    sets = written_once(_sets(docs, width, names), "sets")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    total = sets.agg(F.sum("_size")).first()[0] or 0
    buckets = max(-(-total // BUCKET), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    repeated = _classes(_ordered(_laid_out(texts, width, buckets)), similarity)
    first = F.min_by(F.struct(*repeated.columns), "class").alias("x")
    classes = written_once(repeated.groupBy("high", "low").agg(first).select("x.*"), "classes")
    facts = classes.select("class", "size", "own", "sketch")

    members = classes.select("class", "size", "own", F.explode(F.slice("tokens", 1, F.col("first"))).alias("token"))
    centre = F.min(F.struct((F.col("own") / F.col("size")).alias("share"), "class")).alias("_centre")
    shared = members.groupBy("token").agg(centre, F.count("*").alias("_members")).where("_members > 1")
    met = members.select("token", "class").join(shared.select("token", F.col("_centre.class").alias("centre")), "token")
    met = written_once(met, "buckets")
    segments = written_once(_segments(classes, fragments), "segments")

    links = written_once(_counted(_about_centres(met, facts, similarity), segments, facts, similarity), "links")
    roots = components(links)
    more = _across(met, facts, roots, similarity)
    more = written_once(_counted(more, segments, facts, similarity), "more-links")
    if not more.isEmpty():
        roots = components(links.unionAll(more))

    rooted = classes.select("class", F.col("high").alias("_high"), F.col("low").alias("_low")).join(
        roots.select(F.col("node").alias("class"), F.col("root").alias("_root")), "class"
    )
    lowest = sets.where("_size > 0").groupBy("_high", "_low").agg(F.min("_document._id").alias("_least"))
    lowest = lowest.join(rooted.drop("class"), ["_high", "_low"], "left")
    lead = lowest.where("_root IS NOT NULL").groupBy("_root").agg(F.min("_least").alias("_lead"))
    named_classes = lowest.join(lead, "_root", "left").select("_high", "_low", F.coalesce("_lead", "_least").alias("_component"))
    labelled = sets.join(named_classes, ["_high", "_low"], "left")
    own = F.col("_document._id")
    return labelled.select(
        *(F.col(f"_document.columns.`{c}`") for c in names),
        F.col("_size").alias("n_shingles"),
        F.when(F.col("_size") > 0, F.col("_component")).otherwise(own).alias("component_id"),
    )


def op12(docs: DataFrame) -> DataFrame:
    """The contract: 5-word shingles at 80 %."""
    return joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), carried=["doc_id"])


ORACLE_OP12 = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN w WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words
), sizes AS (
  SELECT r, doc_id, CAST(len(s) AS BIGINT) AS n FROM sets
), grams AS (
  SELECT sets.r, n, unnest(s) AS g FROM sets JOIN sizes ON sets.r = sizes.r
), links AS (
  SELECT a.r AS u, b.r AS v
  FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(r, o) AS (
  SELECT r, r FROM sizes UNION SELECT reach.r, v FROM reach JOIN edges ON u = reach.o
), component AS (
  SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN sizes ON sizes.r = reach.o GROUP BY reach.r
)
SELECT doc_id, n AS n_shingles, component_id FROM sizes JOIN component ON component.r = sizes.r
"""
