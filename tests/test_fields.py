"""Fits and fields against numpy and known truths."""

import numpy as np
from pyspark.sql import functions as F

from aeonframe.operators import fields as L


def test_counts_are_numpy(spark):
    r = np.random.default_rng(0)
    x = np.column_stack([np.ones(300), r.normal(size=300)])
    e = r.uniform(0.5, 2, 300)
    y = r.poisson(e * np.exp(x @ [0.5, 0.7]))
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, e)], "one double, x double, y double, e double")
    penalty = np.diag([0.0, 0.3])
    beta, covariance, dispersion = L.fit_counts(df, ["one", "x"], "y", "e", penalty)
    b = np.zeros(2)
    for _ in range(50):
        mu = e * np.exp(x @ b)
        b = b + np.clip(np.linalg.solve(x.T @ (x * mu[:, None]) + penalty, x.T @ (y - mu) - penalty @ b), -2, 2)
    assert np.allclose(beta, b, atol=1e-6) and 0.6 < dispersion < 1.5 and covariance.shape == (2, 2)


def test_classes(spark):
    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(600), r.normal(size=600)])
    truth = np.array([[0.0, -1.0], [0.3, 0.0], [-0.3, 1.0]])
    p = np.exp(x @ truth.T)
    p /= p.sum(axis=1, keepdims=True)
    y = np.array([r.choice(3, p=q) for q in p])
    df = spark.createDataFrame([(float(a), float(b), int(c), 1.0) for (a, b), c in zip(x, y)], "one double, x double, y int, w double")
    beta, loglik = L.fit_classes(df, ["one", "x"], "y", "w", 3, 0.1)
    assert np.allclose(beta.sum(axis=0), 0) and np.allclose(beta, truth, atol=0.35) and loglik < 0


def test_pair_correlation(spark):
    r = np.random.default_rng(2)
    z = r.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 4000)
    e = r.choice([-0.5, 0.5], size=(4000, 2))
    y = (z + e > 0).astype(int)
    df = spark.createDataFrame([(int(a), float(b), int(c), float(d)) for (a, c), (b, d) in zip(y, e)], "y1 int, e1 double, y2 int, e2 double")
    assert abs(L.pair_correlation(df, ("y1", "e1"), ("y2", "e2")) - 0.6) < 0.08


def test_field(spark):
    basis = L.FieldBasis((0, 0, 0), (10, 10, 10), (4.0, 4.0), (4, 4, 3))
    r = np.random.default_rng(3)
    p = r.uniform(-6, 6, (400, 3))
    rows = [(float(a), float(b), float(c), float(np.exp(0.1 * a)), 1.0) for a, b, c in p]
    df = spark.createDataFrame(rows, "x double, y double, t double, n double, e double")
    made = L.with_basis(df, basis, "x", "y", "t")
    assert made.count() == 400
    beta, covariance, _ = L.fit_counts(made, basis.names(), "n", "e", np.eye(48) * 0.5)
    grid = spark.createDataFrame([(-5.0, 0.0, 0.0), (5.0, 0.0, 0.0)], "x double, y double, t double")
    low, high = L.predicted(grid, basis, "x", "y", "t", beta, covariance).orderBy("x").collect()
    assert high["mean"] > low["mean"] and high["sd"] > 0


def test_lattice_and_weights(spark):
    grid = L.lattice((0, 0, 1, 0.5), 0.25, [-50, -25], spark)
    assert grid.count() == 16 and grid.select(F.max("lon"), F.min("lat")).first()[0] == 0.875
    scored = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 1.0), ("b", 1.0, 1.0)], "s string, o double, e double")
    rows = {r.s: r for r in L.reliabilities(scored, "s", "o", "e").collect()}
    assert rows["a"].dispersion == 2.0 and rows["b"].reliability == 1.0 and abs(rows["a"].weight + rows["b"].weight - 2) < 1e-9
    cells = spark.createDataFrame([(True, 10.0), (True, 90.0), (False, 5.0), (False, 500.0)], "inside boolean, coast_km double")
    assert [r.support for r in L.support_classes(cells).collect()] == ["coast", "land", "near sea", "far sea"]


def test_ladder(spark):
    rows = spark.createDataFrame([(i % 20, i % 20 % 4, float(i % 2)) for i in range(200)], "c int, f int, y double")
    flat = lambda train, test: test.select("c", "y", F.lit(0.5).alias("p"))
    good = lambda train, test: test.select("c", "y", F.when(F.col("y") == 1, 0.9).otherwise(0.1).alias("p"))
    found = {r.model: r for r in L.model_ladder(rows, {"flat": flat, "good": good}, "f", 4, "c").collect()}
    assert abs(found["flat"].loss - 1) < 1e-9 and found["good"].difference < -0.8
