import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaguard.operators import newton
from mediaguard.operators.vector_jobs import Linear


def by_hand(x, y, m, c):
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, r = np.zeros(x.shape[1]), np.array([1 / c] * (x.shape[1] - 1) + [0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (m * p * (1 - p))[:, None]).T @ x + np.diag(r + 1e-12), x.T @ (m * (p - y)) + r * w)
    return w


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 6))
    y = (x @ rng.standard_normal(6) + rng.standard_normal(400) * 2 > 0.3).astype(int)
    m = np.stack([np.ones(400), np.arange(400) % 3 > 0, (np.arange(400) % 5 == 0) * 2.0, y == 1], axis=1).astype(float)
    df = spark.createDataFrame([(a.tolist(), int(b), c.tolist()) for a, b, c in zip(x, y, m)], "x array<double>, label int, in_models array<double>").repartition(6).cache()
    return x, y, m, df


@pytest.mark.parametrize("c", [1.0, 100.0])
def test_many_fits_equal_each_alone(rows, c):
    x, y, m, df = rows
    got = newton.logistic_many(df, 4, c)
    assert got[3] is None  # one class
    for i in range(3):
        np.testing.assert_allclose([*got[i].w, got[i].b], by_hand(x, y, m[:, i], c), atol=1e-6)


def test_a_step_is_one_job_over_the_rows(spark, rows):
    seen = spark.sparkContext.accumulator(0)
    original = newton.sums
    try:
        newton.sums = lambda *a: (seen.add(1), original(*a))[1]
        newton.logistic_many(rows[3], 4)
    finally:
        newton.sums = original
    assert 3 <= seen.value <= 12  # for all models together


def test_ridge_and_decisions(rows):
    x, y, m, df = rows
    got = newton.ridge_many(df, 4, 0.5)
    x1, t = np.concatenate([x, np.ones((400, 1))], axis=1), 2 * y - 1
    for i in range(4):
        w = np.linalg.solve((x1 * m[:, i:i + 1]).T @ x1 + np.diag([0.5] * 6 + [0]), (x1 * m[:, i:i + 1]).T @ t)
        np.testing.assert_allclose([*got[i].w, got[i].b], w, atol=1e-8)
    z = newton.decide_many(df.select("label", "x"), [got[0], None, Linear((0.0,) * 6, 2.0)]).collect()
    assert all(r.zs[1] is None and r.zs[2] == 2.0 for r in z) and len(z) == 400


def test_no_rows(spark):
    df = spark.createDataFrame([], "x array<double>, label int, in_models array<double>")
    assert newton.logistic_many(df, 2) == [None, None] and newton.ridge_many(df, 2) == [None, None]


def test_sigmoids_of_many_groups(spark):
    df = spark.range(6000).selectExpr("id % 30 AS g", "cast(xxhash64(id) % 1000 AS double) / 500 AS s", "cast(xxhash64(id, 1) % 1000 + xxhash64(id) % 1000 * 0.7 > 0 AS int) AS y")
    df = df.unionByName(spark.createDataFrame([(99, 1.0, 1), (99, 2.0, 1), (98, None, 0), (97, 0.5, None)], "g long, s double, y int"))
    got = {r.g: r for r in newton.sigmoids_by(df, ["g"], "s", "y", c=1.0).collect()}
    assert set(got) == {*range(30), 99} and got[99].a is None and got[99].n == 2
    for g in (0, 7, 29):
        own = df.where(F.col("g") == g).toPandas()
        want = by_hand(own[["s"]].to_numpy(), own.y.to_numpy(), np.ones(len(own)), 1.0)
        assert math.isclose(got[g].a, want[0], abs_tol=1e-6) and math.isclose(got[g].b, want[1], abs_tol=1e-6) and got[g].n == len(own)
