"""Walsh-Hadamard progressive search against full distances."""

import math
import random

import numpy as np

from gapfeed.llm import centroid_clusters as C

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def run(vectors, **how):
    return sorted(tuple(r) for r in C.cluster(vectors, **how).select(COLUMNS).collect())


def want(vectors, **how):
    found = C.brute_force(vectors.toPandas(), **how)
    return sorted(tuple(r) for r in found[COLUMNS].itertuples(index=False, name=None))


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3000, 3000, (20, 64)), rng.integers(-3000, 3000, (20, 64))
    d = C.transform(a) - C.transform(b)
    assert np.array_equal((d * d).sum(axis=1), 64 * ((a - b) ** 2).sum(axis=1))
    signs = np.count_nonzero(np.diff(C.hadamard(64), axis=1), axis=1)
    assert signs.tolist() == list(range(64))


def test_ties_go_to_the_smaller_number():
    c = np.array([[5] * 64, [1] * 64, [1] * 64, [-1] * 64])
    v = np.array([[0] * 64, [1] * 64, [-1] * 64, [3] * 64])
    number, distance = C.nearest(v, c)
    assert number.tolist() == [1, 1, 3, 0]
    assert distance.tolist() == [64, 0, 0, 256]


def test_equals_full_distances(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(11)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in centres[min(i % 17, 10)]]) for i in range(400)]
    rows += [(i + 400, rows[7][1]) for i in range(200)]  # a third of all rows are one vector
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert run(vectors) == want(vectors)
    assert run(vectors, k=3, rounds=2) == want(vectors, k=3, rounds=2)


def test_given_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert run(vectors) == want(vectors)


def test_odd_vectors(spark):
    x = [0.5] * 64
    rows = [(0, x), (1, None), (2, [0.5] * 63), (3, [math.nan] + x[1:]), (4, x[:-1] + [math.inf]), (5, [None] + x[1:]), (6, []), (7, [-0.25] * 64), (7, [-0.25] * 64), (None, [9.0] * 64)]
    vectors = spark.createDataFrame([(*r, 3, "d") for r in rows], "vec_id long, embedding array<float>, cluster int, distance string")
    got = C.cluster(vectors, k=8).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in got) == [-1, 0, 7, 7]
    assert len({r.inertia for r in got}) == 1
    assert run(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []
    assert run(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")) == []


def test_components_of_any_size(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 30) for _ in range(64)]) for i in range(30)]
    rows += [(i + 30, [rng.uniform(-1, 1) * 2.0**20 for _ in range(64)]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = 2**63 - 1
    assert run(vectors, k=4, rounds=3) == sorted((i, c, min(d, most), min(ci, most), min(a, most), h) for i, c, d, ci, a, h in want(vectors, k=4, rounds=3))
