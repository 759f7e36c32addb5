import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from profilescope.llm.topk import integer_vectors, op6, search_block, top_k

INF = float("inf")


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10**6), st.integers(1, 90), st.integers(1, 6), st.sampled_from([2, 30, 10**9]))
def test_blocks_match_brute_force(seed, n, k, span):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(n).astype(np.int64)
    vectors = rng.integers(-span, span, (n, 5)).astype(float)
    queries = rng.integers(-span, span, (3, 5)).astype(float)
    query_ids = np.array([0, n + 5, int(ids[0])])
    got = search_block(query_ids, queries, ids, vectors, k)
    for q in range(3):
        scores = [
            (-sum(int(a) * int(b) for a, b in zip(queries[q], v, strict=True)), int(i))
            for i, v in zip(ids, vectors, strict=True)
            if i != query_ids[q]
        ]
        assert [(i, s) for p, i, s in got if p == q] == [(i, -s) for s, i in sorted(scores)[:k]]


@pytest.mark.parametrize("copies", [1, 2, 9, 70])
def test_repeated_rows_of_the_query_hide_no_neighbour(copies):
    """Copies of the query's own row score highest in a block of more than 4k rows, and none of them counts."""
    rng = np.random.default_rng(copies)
    ids = np.concatenate([np.zeros(copies, dtype=np.int64), np.arange(1, 91)])
    vectors = rng.integers(-30, 30, (len(ids), 5)).astype(float)
    vectors[:copies] = 100
    query = np.full((1, 5), 100.0)
    for k in (1, 3, 6):
        got = search_block(np.array([0]), query, ids, vectors, k)
        scores = sorted((-int(v @ query[0]), int(i)) for i, v in zip(ids, vectors, strict=True) if i)
        assert [(i, s) for _, i, s in got] == [(i, -s) for s, i in scores[:k]]


def test_odd_vectors(spark):
    rows = [
        (0, [0.5, 0.5]), (50, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [-0.5, 0.1]), (3, None), (4, [None, 1.0]),
        (5, [float("nan"), 1.0]), (6, [INF, 1.0]), (None, [1.0, 1.0]), (7, []), (0, [0.5, 0.5]), (8, [1.0, 1.0, 1.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string".replace(", query_id string", ""))
    got = [tuple(r) for r in op6(frame).orderBy("query_id", "rank").collect()]
    same = 2 * 128 * 128
    assert got == [
        (0, 1, 1, same), (0, 2, 1, same), (0, 3, 50, same), (0, 4, 2, 128 * -128 + 128 * 25),
        (50, 1, 0, same), (50, 2, 0, same), (50, 3, 1, same), (50, 4, 1, same), (50, 5, 2, 128 * -128 + 128 * 25),
    ]
    assert op6(frame.where("false")).count() == 0


@pytest.mark.parametrize("size", [2, 7])
def test_small_blocks_give_the_same(spark, size):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    vectors = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = vectors.where("vec_id % 20 = 0")
    whole = sorted(map(tuple, top_k(asked, vectors, 3).collect()))
    assert whole == sorted(map(tuple, top_k(asked, vectors, 3, query_block=size, candidate_block=size * 9).collect()))
