"""Near duplicates of embeddings against all pairs."""

import math

import numpy as np
import pytest

from gapfeed.llm import embedding_dedup as D

COLUMNS = ["vec_id", "n_links", "component_id", "kept"]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def run(vectors, **how):
    return order(tuple(r) for r in D.near_components(vectors, **how).select(COLUMNS).collect())


def want(vectors):
    return order(tuple(r) for r in D.brute_force(vectors.toPandas())[COLUMNS].itertuples(index=False, name=None))


def made(spark, n=500, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dim))
    rows[100:150] = rows[:50] + rng.normal(size=(50, dim)) * 0.2  # near the bound on either side
    rows[150:260] = rows[7] * rng.uniform(0.5, 2, size=(110, 1)) + rng.normal(size=(110, dim)) * 0.02  # a hot group
    rows[260:330] = rows[9]  # copies
    rows[330:360] = rows[11][None] + np.linspace(0, 4, 30)[:, None] * rows[12][None]  # a chain
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)


def test_equals_all_pairs_with_the_whole_margin(spark):
    vectors = made(spark)
    expected = want(vectors)
    whole = math.sqrt(1 - 0.81)
    assert run(vectors, margin=whole) == expected
    assert run(vectors, margin=whole, block=17) == expected  # many blocks a cell


def test_recall_of_the_usual_margin(spark):
    vectors = made(spark, n=600, seed=3, dim=64)
    found, all_links = (sum(r[1] for r in x) for x in (run(vectors), want(vectors)))
    assert 0.98 * all_links <= found <= all_links


def test_given_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert run(vectors) == want(vectors)


def test_fit_on_a_share_of_the_rows(spark):
    vectors = made(spark, seed=5)
    assert run(vectors, margin=math.sqrt(1 - 0.81), fit_rows=120) == want(vectors)


def test_odd_vectors(spark):
    x = [1.0, 2.0, -1.0]
    rows = [(5, x), (3, x), (3, x), (None, [2.0, 4.0, -2.0]), (9, None), (10, []), (11, [0.0, 0.0, 0.0]), (12, [1.0, None, 1.0]), (13, [math.nan, 1.0, 1.0]), (14, [math.inf, 1.0, 1.0]), (15, [1.0, 2.0]), (16, [3.0, 6.0]), (None, None), (17, [1e300, 1e300, 0.0]), (18, [1e-300, 1e-300, 0.0]), (None, [-5.0, 1.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 1, "h", 2) for r in rows], "vec_id long, embedding array<double>, n_links int, home string, node int")
    got = run(vectors)
    assert got == want(vectors)
    assert (5, 3, 3, False) in got and got.count((3, 3, 3, True)) == 2 and (18, 1, 17, False) in got and (16, 1, 15, False) in got
    assert D.keep_one(vectors).where("vec_id in (3, 5, 18)").count() == 2
    assert run(vectors.where("1 = 0")) == []
    assert run(vectors.where("vec_id = 9")) == [(9, 0, 9, True)]


@pytest.mark.parametrize("own", [True, False])
def test_bound_is_exact(own):
    x = np.array([[1.0, 0.0], [0.9, math.sqrt(1 - 0.81)], [0.8, 0.6]])
    strips, _ = D.compare(x, None if own else x, 0.9)
    linked = np.concatenate([m for _, m in strips])
    assert linked[0, 1] == D.exact_at_least(x[0], x[1], 0.9)
    assert linked[1, 2] and not linked[0, 2]
    assert linked[0, 0] != own
