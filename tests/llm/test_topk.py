"""Exact search against all pairs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gapfeed.llm import topk_search as S


def run(vectors, k=5, every=10, **how):
    return sorted(tuple(r) for r in S.top_k(vectors, F.col("vec_id") % every == 0, k=k, **how).collect())


def test_equals_all_pairs(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(5)]
    rows = []
    for i in range(300):
        c = centres[i % 5]
        rows.append((i, [round(x + rng.gauss(0, 0.05), 2) for x in c]))
    rows += [(300 + i, list(rows[i][1])) for i in range(20)]  # ties
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    want = S.brute_force(vectors.toPandas(), 5, 10)
    want = sorted(map(tuple, want[["query_id", "rank", "vec_id", "score"]].astype(int).values.tolist()))
    assert run(vectors) == want
    assert run(vectors, query_rows=7, block_rows=40) == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (5, [0.5, -0.5]), (None, [9.0, 9.0]), (10, [1.0, 2.0, 3.0]), (20, []), (30, [0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<float>, score int, rank string")
    assert run(vectors) == [(0, 1, 30, 0), (0, 2, 5, -32768), (30, 1, 0, 0), (30, 2, 5, 0)]


def test_large_components(spark):
    rows = [(0, [3e30, 1.0]), (1, [2e30, 0.0]), (2, [-1e30, 5.0]), (3, [0.0, 7.0]), (4, [1.0, 1.0]), (10, [2.0**40, 2.0**40 + 2.0**20])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    exact = {i: [math.floor(x * 256) for x in v] for i, v in rows}
    want = []
    for q in (0, 10):
        scored = sorted((-sum(a * b for a, b in zip(exact[q], exact[i])), i) for i in exact if i != q)[:3]
        want += [(q, r, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scored, 1)]
    got = run(vectors, k=3)
    assert sorted((q, i, s) for q, _, i, s in got) == sorted((q, i, s) for q, _, i, s in want)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, v = np.floor(rng.normal(size=(20, 64)) * 256), np.floor(rng.normal(size=(30, 64)) * 256)
    for n in S.levels(64):
        assert np.all(S.statistics(q, n) @ S.statistics(v, n).T >= q @ v.T - 1e-6)


def test_empty(spark):
    assert run(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []


def test_ties_of_negative_scores(spark):
    rows = [(0, [1.0] * 64)] + [(i, [-1.0] * 64) for i in range(5001, 1, -1)] + [(10_000, [1.0] * 32 + [0.5] * 32)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = [r for r in run(vectors, every=1_000_000)]
    assert got == [(0, 1, 10_000, 65536 * 32 + 32768 * 32)] + [(0, r, i, -64 * 65536) for r, i in zip(range(2, 6), range(2, 6))]
    assert [r[2] for r in run(vectors.where("vec_id < 9000"), every=1_000_000, block_rows=1000)] == [2, 3, 4, 5, 6]


def test_all_scores_negative_in_any_order(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-3.0, -2.0, -2.0]) if i % 10 else 1.0 + (i % 3) for _ in range(16)]) for i in range(400)]
    rng.shuffle(rows)
    vectors = spark.createDataFrame([r for r in rows if r[0] % 10 or r[0] < 30], "vec_id long, embedding array<float>").repartition(3)
    want = S.brute_force(vectors.toPandas(), 5, 10)
    want = sorted(map(tuple, want[["query_id", "rank", "vec_id", "score"]].astype(int).values.tolist()))
    assert run(vectors, block_rows=50) == want
