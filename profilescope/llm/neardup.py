"""Operator 7: near-duplicate documents by fast similarity sketches, banding and exact verification.

1. One pass makes each text's shingle set, the set's digest and its sketch (see ``sketching.py``). Documents with
   equal sets are one class; one of them stands for it from here on.
2. The sketch's 252 coordinates form 42 bands of 6. Classes that agree in a band share a bucket: two sets of
   similarity 0.8 miss each other with a probability of 3e-6. In each bucket all classes are compared with the smallest only,
   pairs whose sketches agree in fewer than 69 % of the coordinates (4.5 standard deviations below 0.8) are
   dropped, and the rest are confirmed on the full sets of their texts.
3. Components of confirmed links. In most buckets all classes are then in one component, and nothing is left to
   learn. In large buckets that are still open, shingles that one class alone has are counted; all classes are
   compared in full with the one that has the fewest, and components are made anew.
4. In buckets that are open even now, classes outside the component of the bucket's smallest class are compared with all
   classes of other components, in blocks of bounded size. Pairs that could reach the similarity without their own
   shingles and pass the sketch test are confirmed on the full sets.
5. Components of all links. No bucket is capped and no pair of a bucket is left out, but for those whose
   link could not change a component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilescope.llm.common import probably_listed, row_numbers, set_aside, written_once
from profilescope.llm.components import components
from profilescope.llm.sketching import Shingler, Sketcher

COORDINATES, ROWS = 252, 6
#: Share of sketch coordinates that a pair must share to be confirmed on full sets.
MIN_AGREEMENT = 0.69
#: Classes of a bucket on either side of one comparison block.
BLOCK = 256
#: Members from which a bucket counts as large, and shingles that a task counts before it hands them on.
LARGE, COUNTED = 64, 500_000
SIMILARITY = 80  # per cent
WIDTH = 5


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """``_document``, a struct of the columns, with a row id, the size and digest of their shingle set, its band keys and its fingerprint."""
    extra = "_row bigint, _size bigint, _digest binary, _bands array<bigint>, _print binary"
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_document"))
    schema = T.StructType(rows.schema.fields + T.StructType.fromDDL(extra).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketcher, made = Shingler(width), Sketcher(COORDINATES), 0
        for batch in batches:
            sizes, digests, bands, prints = [], [], [], []
            for text in batch.column(0).field("text"):
                found = shingler.shingles(text.as_py())
                sizes.append(len(found))
                if not len(found):
                    digests.append(None), bands.append(None), prints.append(None)
                    continue
                sketch = sketcher.sketch(found)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bands.append(sketcher.band_keys(sketch, ROWS).view(np.int64))
                prints.append(sketcher.fingerprint(sketch))
            numbers = pa.array(row_numbers(len(batch), made), pa.int64())
            made += len(batch)
            more = [
                numbers,
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(prints, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, class, members, centre): a row for each band of a class, in buckets of more than one class."""
    rows = classes.select(F.explode("_bands").alias("key"), "class")
    bucket = Window.partitionBy("key")
    shared = rows.withColumns({"members": F.count(F.lit(1)).over(bucket), "centre": F.min("class").over(bucket)})
    return shared.where("members > 1")


def _similar_sizes(a: Column, b: Column, similarity: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * similarity


def _agreeing(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v) of classes whose sizes and sketches allow the similarity."""

    def side(name: str) -> DataFrame:
        return classes.select(F.col("class").alias(name), F.col("_size").alias(f"{name}_size"), F.col("_print").alias(f"{name}_print"))

    both = pairs.join(side("u"), "u").join(side("v"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_matrix(batch.column(i)) for i in (2, 3))
            good = (left == right).mean(1) >= MIN_AGREEMENT if len(batch) else np.empty(0, dtype=bool)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    sized = both.where(_similar_sizes(F.col("u_size"), F.col("v_size"), similarity))
    return sized.select("u", "v", "u_print", "v_print").mapInArrow(run, "u long, v long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """The pairs whose full shingle sets have the similarity."""
    pairs = written_once(pairs, "pairs")

    def side(name: str) -> DataFrame:
        own = texts.select(F.col("class").alias(name), F.col("text").alias(f"{name}_text"))
        return probably_listed(own, name, pairs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        last: tuple[str | None, np.ndarray] = (None, np.empty(0))
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                if (text := a.as_py()) != last[0]:  # pairs of one class follow one another
                    last = (text, shingler.shingles(text))
                left, right = last[1], shingler.shingles(b.as_py())
                common = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * common >= similarity * (len(left) + len(right) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(side("v"), "v").join(side("u"), "u")
    return both.select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long")


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, class, root, main, members) of the buckets whose classes lie in more than one component; ``main`` is
    the component of the bucket's smallest class."""
    known = roots.select(F.col("node").alias("class"), "root")
    rows = buckets.drop("members").join(known, "class", "left").select(
        "key", "class", "centre", F.coalesce("root", "class").alias("root")
    )
    state = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"),
        F.max(F.when(F.col("class") == F.col("centre"), F.col("root"))).alias("main"),
        F.min("root").alias("_least"),
        F.max("root").alias("_most"),
    )
    split = state.where("_least <> _most").select("key", "main", "members")
    return written_once(rows.drop("centre").join(split, "key"), "open-buckets")


def _own_shingles(classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(class, own): how many of its shingles no other of the classes has.

    No two of these classes can share more than the rest, which bounds their similarity. It says nothing about
    other classes, which may hold such shingles too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(width), {}

        def counted() -> pa.RecordBatch:
            columns = [pa.array(seen, pa.int64()), *(pa.array([x[i] for x in seen.values()], pa.int64()) for i in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, ["shingle", "holders", "class"])

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for shingle in shingler.shingles(text.as_py()).view(np.int64).tolist():
                    holders, _ = seen.get(shingle, (0, 0))
                    seen[shingle] = (holders + 1, number)
                if len(seen) >= COUNTED:
                    yield counted()
                    seen.clear()
        yield counted()

    wanted = probably_listed(texts, "class", classes, "class").join(classes, "class")
    rows = wanted.select("class", "text").mapInArrow(run, "shingle long, holders long, class long")
    held = rows.groupBy("shingle").agg(F.sum("holders").alias("holders"), F.max("class").alias("class"))
    own = held.where("holders = 1").groupBy("class").agg(F.count(F.lit(1)).alias("own"))
    return classes.join(own, "class", "left").na.fill({"own": 0})


def _about_centres(
    open_: DataFrame, classes: DataFrame, own: DataFrame, texts: DataFrame, width: int
) -> tuple[DataFrame, DataFrame]:
    """(key, centre) of large open buckets, and (class, centre, _mask, _inside, _centre_size) of their classes.

    The centre of a bucket is the class with the smallest share of own shingles: among edited copies of a text that is
    the text itself, or the copy with the fewest edits. A mask says which of the centre's shingles a class has.
    """
    large = open_.where(F.col("members") > LARGE)
    sizes = probably_listed(classes.select("class", "_size"), "class", large, "class")
    share = F.coalesce("own", F.lit(0)) / F.col("_size")
    rows = written_once(large.join(sizes, "class").join(own, "class", "left").withColumn("_share", share), "large-open")
    best = F.min(F.struct("_share", "class")).alias("best")
    centres = written_once(rows.groupBy("key").agg(best).select("key", F.col("best.class").alias("centre")), "centres")
    pairs = written_once(rows.select("key", "class").join(centres, "key").select("class", "centre").distinct(), "spokes")

    def side(name: str) -> DataFrame:
        own_texts = texts.select(F.col("class").alias(name), F.col("text").alias(f"{name}_text"))
        return probably_listed(own_texts, name, pairs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        last: tuple[str | None, np.ndarray] = (None, np.empty(0))
        for batch in batches:
            masks, inside, lengths = [], [], []
            for text, central in zip(batch.column(2), batch.column(3), strict=True):
                if (whole := central.as_py()) != last[0]:
                    last = (whole, shingler.shingles(whole))
                held = np.isin(last[1], shingler.shingles(text.as_py()), assume_unique=True)
                masks.append(np.packbits(held).tobytes())
                inside.append(int(held.sum()))
                lengths.append(len(held))
            more = [pa.array(masks, pa.binary()), pa.array(inside, pa.int64()), pa.array(lengths, pa.int64())]
            names = ["class", "centre", "_mask", "_inside", "_centre_size"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names)

    both = pairs.join(side("class"), "class").join(side("centre"), "centre")
    schema = "class long, centre long, _mask binary, _inside long, _centre_size long"
    masked = both.select("class", "centre", "class_text", "centre_text").mapInArrow(run, schema)
    return centres, written_once(masked, "masks")


def _across(
    open_: DataFrame, classes: DataFrame, own: DataFrame, about: tuple[DataFrame, DataFrame] | None, similarity: int
) -> DataFrame:
    """Pairs of classes that share a bucket but no component, and whose sizes, shingles and sketches allow a link.

    In a large bucket two classes have in common: of its centre's shingles those in both masks, and of other
    shingles no more than either has beside its own ones. That bounds their similarity closely. Own shingles count
    only between two classes of ``own``; in small buckets there are others, with an ``own`` of -1.

    In a bucket, classes outside the component of its smallest class meet all its classes in blocks of about
    ``BLOCK`` by ``BLOCK``. A pair is reported in the first band that it shares.
    """
    outside = open_.where("root <> main").groupBy("key").agg(F.count(F.lit(1)).alias("strays"))
    facts = classes.select("class", "_size", "_bands", "_print")
    facts = probably_listed(facts, "class", open_, "class").join(own, "class", "left").na.fill({"own": -1})
    open_ = open_.join(outside, "key").join(facts, "class")
    if about is None:
        none = {"_mask": F.lit(None).cast("binary"), "_rest": F.lit(None).cast("long"), "_centre_size": F.lit(None).cast("long")}
        open_ = open_.withColumns(none)
    else:
        centres, masked = about
        open_ = open_.join(centres, "key", "left").join(masked, ["class", "centre"], "left")
        open_ = open_.withColumn("_rest", F.col("_size") - F.col("_inside") - F.col("own"))
    open_ = written_once(open_, "open-classes")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    mine = lambda n, seed: F.pmod(F.xxhash64("class", F.lit(seed)), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    facts_of = ["class", "root", "_size", "own", "_bands", "_print", "_mask", "_rest", "_centre_size"]
    strays = open_.where("root <> main").select(
        "key", F.lit(True).alias("stray"), mine("strays", 1).alias("b1"), every("members").alias("b2"), *facts_of
    )
    others = open_.select(
        "key", F.lit(False).alias("stray"), every("strays").alias("b1"), mine("members", 2).alias("b2"), *facts_of
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame | None:
        left, right = group[group["stray"]], group[~group["stray"]]
        if left.empty or right.empty:
            return None
        prints = [np.frombuffer(b"".join(x["_print"]), dtype=np.uint8).reshape(-1, COORDINATES) for x in (left, right)]
        bands = [np.stack(x["_bands"]) for x in (left, right)]
        ids, roots_, sizes, owns = ([x[c].to_numpy() for x in (left, right)] for c in ("class", "root", "_size", "own"))
        key = np.int64(group["key"].iloc[0])
        masks = rests = None
        if group["_mask"].notna().all():
            length = int(group["_centre_size"].iloc[0])
            packed = [np.frombuffer(b"".join(x["_mask"]), dtype=np.uint8).reshape(len(x), -1) for x in (left, right)]
            masks = [np.unpackbits(x, axis=1, count=length).astype(np.float32) for x in packed]
            rests = [x["_rest"].to_numpy() for x in (left, right)]
        found = []
        for i in range(len(left)):
            counted = (owns[0][i] >= 0) & (owns[1] >= 0)
            common = np.minimum(sizes[0][i] - counted * owns[0][i], sizes[1] - counted * owns[1])
            if masks is not None:
                common = np.minimum(common, masks[1] @ masks[0][i] + np.minimum(rests[0][i], rests[1]))
            union = sizes[0][i] + sizes[1] - common
            may = (roots_[0][i] != roots_[1]) & (100 * common >= similarity * union)
            may[may] = (prints[0][i] == prints[1][may]).mean(1) >= MIN_AGREEMENT
            hits = np.flatnonzero(may)
            if len(hits):
                first = (bands[0][i] == bands[1][hits]).argmax(1)
                hits = hits[bands[0][i][first] == key]
            found += [(ids[0][i], ids[1][j]) for j in hits]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64") if found else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None  # the group at the end of the last frame may go on
        block = ["key", "b1", "b2"]
        for frame in frames:
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            if frame.empty:
                continue
            marks = frame[block].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]).any(1)]))
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                if (found := compare(frame.iloc[start:end])) is not None:
                    yield found
            left = frame.iloc[starts[-1] :].reset_index(drop=True)
        if left is not None and (found := compare(left)) is not None:
            yield found

    meeting = strays.unionAll(others).repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    pairs = meeting.mapInPandas(run, "u long, v long")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def cluster(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """All documents, with ``n_shingles``, ``component_id`` and ``first``.

    Linked are documents whose sets of distinct ``width``-word shingles have 100 * intersection >= similarity *
    union. component_id is the smallest doc_id reachable; ``first`` marks one row of each component, that with
    the smallest doc_id. Nulls: texts without words (null, empty, white space) have no shingles and are
    linked with nothing: each such row is its own component, first in it; a null doc_id takes part and loses to any
    other id, and a component of null ids alone has a null id. Repeated rows are one class and link. An
    empty table gives no rows. Columns with the names of the three results are replaced; other names are free.
    """
    named = docs.drop("n_shingles", "component_id", "first")
    rows = written_once(sketched(named, width), "sketches")
    sets = rows.where("_size > 0").groupBy("_digest").agg(F.min("_row").alias("class"))
    classes_of = written_once(sets, "classes")
    facts = rows.select(F.col("_row").alias("class"), "_size", "_bands", "_print")
    classes = written_once(facts.join(classes_of.select("class"), "class", "left_semi"), "class-sketches")
    buckets = written_once(_buckets(classes), "buckets")
    texts = rows.select(F.col("_row").alias("class"), F.col("_document.text").alias("text"))

    stars = buckets.where("class <> centre").select(F.col("class").alias("u"), F.col("centre").alias("v")).distinct()
    links = written_once(_confirmed(_agreeing(stars, classes, similarity), texts, width, similarity), "star-links")
    roots = components(links)
    open_ = _open(buckets, roots)
    large = written_once(open_.where(F.col("members") > LARGE).select("class").distinct(), "large-buckets")
    own = written_once(_own_shingles(large, texts, width), "own-shingles")
    about = None
    if not large.isEmpty():
        about = _about_centres(open_, classes, own, texts, width)
        spokes = about[1].join(probably_listed(classes.select("class", "_size"), "class", large, "class"), "class")
        union = F.col("_size") + F.col("_centre_size") - F.col("_inside")
        spokes = spokes.where(F.col("_inside") * 100 >= union * similarity)
        links = links.unionAll(spokes.select(F.col("class").alias("u"), F.col("centre").alias("v")))
        roots = components(links)
        open_ = _open(buckets, roots)
    more = _confirmed(_across(open_, classes, own, about, similarity), texts, width, similarity)
    more = written_once(more, "cross-links")
    if not more.isEmpty():
        roots = components(links.unionAll(more))

    grouped = classes_of.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
        "_digest", F.coalesce("root", "class").alias("_root")
    )
    members = written_once(
        rows.select("_row", F.col("_document.doc_id").cast("long").alias("_id"), "_digest")
        .where("_digest IS NOT NULL")
        .join(grouped, "_digest")
        .select("_row", "_id", "_root"),
        "members",
    )
    lowest = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    leaders = members.groupBy("_root").agg(lowest.alias("_lead"))
    labels = members.join(leaders, "_root").select(
        "_row", F.col("_lead.id").alias("_component"), (F.col("_lead.row") == F.col("_row")).alias("_first")
    )
    return rows.join(labels, "_row", "left").select(
        "_document.*",
        F.col("_size").alias("n_shingles"),
        F.when(F.col("_size") > 0, F.col("_component")).otherwise(F.col("_document.doc_id").cast("long")).alias("component_id"),
        F.coalesce("_first", F.lit(True)).alias("first"),
    )


def op7(docs: DataFrame) -> DataFrame:
    """The contract: 2-word shingles at 80 %; a document is kept if its id is its component's."""
    found = cluster(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), 2)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies (5-word shingles, 80 %), with its columns."""
    bare, columns = set_aside(docs, "doc_id", "text")
    return cluster(bare).where("first").select(*columns)


ORACLE_OP7 = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
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
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN component ON component.r = sizes.r
"""
