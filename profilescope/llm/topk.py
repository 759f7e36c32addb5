"""Operator 6: exact top-k search by aggregation without random access (NRA).

Candidates lie in blocks. In a block every dimension is a list sorted by value, which a query reads from the top where
its weight is positive and from the bottom where it is negative, all lists to the same depth. What has been read
gives a candidate a lower bound (unread components at their worst) and an upper bound (unread components at the
list's frontier). Reading stops for a query when no candidate outside its k best lower bounds can still qualify,
or at the lists' end; the scores of those that may qualify are then resolved in full. Fagin, Lotem and Naor,
"Optimal aggregation algorithms for middleware", 2003.

All queries of a block of queries read a block of candidates together, so a step of depth is two matrix products
on each side. Query blocks meet candidate blocks in a co-grouped join: every pair of blocks once, nothing larger in
one task than two blocks. The k best of each pair are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
#: Shares of the lists' length after which bounds are compared.
DEPTHS = (0.1, 0.25, 0.5, 0.75)
_EXACT = float(1 << 53)


class SortedLists:
    """The per-dimension sorted lists of a block of integer vectors."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(vectors))[:, None], axis=0)

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, query by candidate, after ``depth`` entries of every list.

        ``up`` and ``down`` hold the queries' positive and negative weights, zero elsewhere.
        """
        n = len(self.vectors)
        low = high = 0.0
        for weights, seen, frontier, worst in (
            (up, self.rank >= n - depth, self.sorted[n - depth], self.sorted[0]),
            (down, self.rank < depth, self.sorted[depth - 1], self.sorted[-1]),
        ):
            known = np.where(seen, self.vectors, 0.0)
            low = low + weights @ (known + np.where(seen, 0.0, worst)).T
            high = high + weights @ (known + np.where(seen, 0.0, frontier)).T
        return low, high

    def ceiling(self, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The highest score that any candidate could have, before anything but the lists' heads is read."""
        return up @ self.sorted[-1] + down @ self.sorted[0]


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """(query position, id, score) of each query's k best in a block, ties to the smaller id, own id left out."""
    if not len(ids) or not len(query_ids):
        return []
    if len(ids) and vectors.shape[1] != queries.shape[1]:
        raise ValueError("vectors of one search must have one length")
    largest = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(vectors).max(initial=0))
    exact = largest * max(1, queries.shape[1]) < _EXACT
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    n, out = len(ids), []
    may = ids != query_ids[:, None]
    if exact and n > 4 * k:
        lists = SortedLists(vectors)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        open_ = np.arange(len(queries))
        for share in DEPTHS:
            depth = max(1, int(share * n))
            low, high = lists.bounds(up[open_], down[open_], depth)
            low[ids == query_ids[open_, None]] = -np.inf  # rows of the query's own id raise no bar for others
            line = np.partition(low, n - k, axis=1)[:, n - k]
            may[open_] &= high >= line[:, None]
            open_ = open_[may[open_].sum(1) > 4 * k]
            if not len(open_):
                break
    for q in range(len(queries)):
        left = np.flatnonzero(may[q])
        if exact:
            scores = vectors[left] @ queries[q]
            if len(left) > 4 * k:  # the k best and all that tie with the last of them
                left, scores = left[keep := scores >= np.partition(scores, -k)[-k]], scores[keep]
            best = np.argsort(-scores, kind="stable")[:k]  # left is in order of ids
            out.extend((q, int(ids[i]), int(s)) for i, s in zip(left[best], scores[best], strict=True))
        else:
            whole = [int(x) for x in queries[q]]
            found = ((sum(a * int(b) for a, b in zip(whole, vectors[i], strict=True)), i) for i in left)
            best = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
            out.extend((q, int(ids[i]), s) for s, i in best)
    return out


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vector): components as floor(scale * x); rows without a vector or an id, with a null or with a
    component that is no finite number take no part, nor do vectors without components."""
    x = F.col("embedding").cast("array<double>")
    usable = x.isNotNull() & (F.size(x) > 0) & F.col("vec_id").isNotNull()
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(usable & good).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("vector"),
    )


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """The k highest integer inner products for each query: query_id, rank, vec_id, score.

    Both tables are (vec_id, vector). A query is not matched with rows of its own id. Repeated candidate rows
    count each; of repeated equal query rows one is asked; queries of one id but different vectors share one
    ranking of their best. Ties go to the smaller vec_id. An empty side gives no rows. Vectors of other lengths
    than a query's are no candidates for it.
    """
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector")).distinct()
    counts = candidates.agg(F.count(F.lit(1)).alias("n")).crossJoin(asked.agg(F.count(F.lit(1)).alias("m"))).first()
    blocks, groups = -(-max(1, counts["n"]) // candidate_block), -(-max(1, counts["m"]) // query_block)

    def spread(column: str, n: int):
        """Rows of one content go round all blocks, so that no vector fills one."""
        return F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.col(column)), F.lit(n)).cast("int")

    width = F.size("vector").alias("width")
    left = asked.select(
        F.pmod(F.xxhash64("query_id", "vector"), F.lit(groups)).cast("int").alias("query_group"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        width,
        "query_id",
        "vector",
    )
    right = candidates.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("query_group"),
        spread("vec_id", blocks).alias("block"),
        width,
        "vec_id",
        "vector",
    )
    keys = ["query_group", "block", "width"]

    def pair(asked_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked_rows) and len(rows):
            ids = asked_rows["query_id"].to_numpy()
            found = search_block(
                ids, np.stack(asked_rows["vector"]), rows["vec_id"].to_numpy(), np.stack(rows["vector"]), k
            )
            found = [(int(ids[q]), i, s) for q, i, s in found]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op6(embeddings: DataFrame) -> DataFrame:
    """Every row whose vec_id is divisible by 50 asks all rows but its own for its five best."""
    rows = integer_vectors(embeddings)
    return top_k(rows.where("vec_id % 50 = 0"), rows)


ORACLE_OP6 = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM usable WHERE vec_id % 50 = 0) q JOIN usable c ON c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
