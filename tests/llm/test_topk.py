"""Exact top-k search against a plain sort of all scores."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from growthlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(queries, rows, k):
    """Rankings by Python integers, one for each query row."""
    def weights(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for q, v in queries:
        if q is None or weights(v) is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(weights(v), weights(c))), i) for i, c in rows
                        if i is not None and i != q and weights(c) is not None)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, queries, rows, k):
    got = topk.search(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(rows, SCHEMA), k)
    return sorted(tuple(r) for r in got.collect())


def test_random_vectors_with_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]
    queries = [r for r in rows if r[0] % 10 == 0]
    assert found(spark, queries, rows, 10) == brute(queries, rows, 10)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]),
            (6, []), (7, [1.0]), (8, [1.0, -1.0, 4.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0])]
    queries = [r for r in rows if r[0] in (0, 1, 2, 3, 4, 5, 6)]
    assert found(spark, queries, rows, 3) == brute(queries, rows, 3)


def test_repeated_ids_have_rankings_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (1, [1.0, 3.0]), (2, [2.0, 2.0])]
    assert found(spark, rows[:2], rows, 2) == brute(rows[:2], rows, 2)


def test_fewer_rows_than_k_and_empty_tables(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert found(spark, rows[:1], rows, 10) == [(0, 1, 1, 1024 * 2048)]
    assert found(spark, [], rows, 10) == []
    assert found(spark, rows, [], 10) == []


def test_extra_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(0, [1.0], 5, 6, 7), (100, [2.0], 5, 6, 7)], SCHEMA + ", score int, rank int, query_id int")
    assert sorted(tuple(r) for r in topk.every_hundredth(rows).collect()) == [(0, 1, 100, 2097152), (100, 1, 0, 2097152)]


def _sparse(vectors):
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    terms = np.concatenate([np.arange(len(v)) for v in vectors]).astype(np.int32)
    return starts, terms, np.array([x for v in vectors for x in v], float)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, -3, 2**20, -(2**30), 2**45]), min_size=3, max_size=3), min_size=1, max_size=12), st.integers(1, 5))
def test_accumulation_is_exact_in_each_kind(vectors, k):
    ids = np.arange(len(vectors))
    block = topk.Postings(ids, *_sparse(vectors))
    scores = block.accumulate(*_sparse(vectors[:2]))
    for q, v in enumerate(vectors[:2]):
        exact = [sum(a * b for a, b in zip(v, c)) for c in vectors]
        assert [int(s) for s in scores[q]] == exact
        want = sorted((-s, i) for i, s in enumerate(exact) if i != q)[:k]
        assert sorted(block.best(scores[q], q, k).tolist()) == sorted(i for _, i in want)


@pytest.mark.parametrize("size", [1, 700])
def test_query_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(size)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(size)]
    queries = rows[::5]
    assert found(spark, queries, rows, 4) == brute(queries, rows, 4)
