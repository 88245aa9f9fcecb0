"""Counts and categories over space and time: log-linear and multinomial fits, fields on a basis, pair correlations, model ladders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from aeonframe.operators.models import bivariate_normal_cdf, sine_basis, spectral_density


def _summed(parts: DataFrame) -> np.ndarray:
    """The element-wise sum of rows of one array column, made on the executors."""
    total = parts.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").collect()
    return np.array([r["x"] for r in total])


def fit_counts(rows: DataFrame, columns: Sequence[str], count: str, exposure: str, penalty: np.ndarray, rounds: int = 30, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their covariance and the dispersion of penalised log-linear counts with an exposure.

    Newton's method; a round reads the rows once and sends k * k sums.
    """
    columns, k = list(columns), len(columns)
    slim, beta = rows.select(*columns, count, exposure), np.zeros(len(columns))
    hessian, chi, n = penalty, 0.0, 1.0

    def sums(at: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(k * k + k + 2)
            for pdf in batches:
                x, y = pdf[columns].to_numpy(float), pdf[count].to_numpy(float)
                mu = pdf[exposure].to_numpy(float) * np.exp(np.clip(x @ at, -30, 30))
                total += np.concatenate([(x.T @ (x * mu[:, None])).ravel(), x.T @ (y - mu), [np.sum((y - mu) ** 2 / np.maximum(mu, 1e-12)), len(y)]])
            yield pd.DataFrame({"v": [total.tolist()]})

        return run

    for _ in range(rounds):
        v = _summed(slim.mapInPandas(sums(beta.copy()), "v array<double>"))
        hessian, chi, n = v[: k * k].reshape(k, k) + penalty, v[-2], v[-1]
        step = np.linalg.solve(hessian, v[k * k : -2] - penalty @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.max(np.abs(step)) < tolerance:
            break
    covariance = np.linalg.inv(hessian)
    used = float(np.trace(covariance @ (hessian - penalty)))
    return beta, covariance, float(chi / max(n - used, 1.0))


def fit_classes(rows: DataFrame, columns: Sequence[str], label: str, weight: str, classes: int, ridge: float, rounds: int = 25, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """(classes, k) coefficients of a ridge multinomial logit and its log likelihood; they sum to zero over classes.

    Newton's method over all classes at once; a round sends (classes * k)
    squared sums, for models of some hundred terms.
    """
    columns, k = list(columns), len(columns)
    size = classes * k
    slim, beta, loglik = rows.select(*columns, label, weight), np.zeros(size), 0.0

    def sums(at: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size * size + size + 1)
            for pdf in batches:
                x, y, w = pdf[columns].to_numpy(float), pdf[label].to_numpy(int), pdf[weight].to_numpy(float)
                eta = x @ at.reshape(classes, k).T
                eta -= eta.max(axis=1, keepdims=True)
                p = np.exp(eta)
                p /= p.sum(axis=1, keepdims=True)
                h = np.zeros((classes, k, classes, k))
                for a in range(classes):
                    for b in range(classes):
                        h[a, :, b, :] = x.T @ (x * (w * p[:, a] * ((a == b) - p[:, b]))[:, None])
                g = ((np.eye(classes)[y] - p) * w[:, None]).T @ x
                total += np.concatenate([h.ravel(), g.ravel(), [np.sum(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)))]])
            yield pd.DataFrame({"v": [total.tolist()]})

        return run

    for _ in range(rounds):
        v = _summed(slim.mapInPandas(sums(beta.copy()), "v array<double>"))
        hessian = v[: size * size].reshape(size, size) + ridge * np.eye(size)
        step = np.linalg.solve(hessian, v[size * size : -1] - ridge * beta)
        loglik = float(v[-1])
        beta = beta + np.clip(step, -2, 2)
        if np.max(np.abs(step)) < tolerance:
            break
    beta = beta.reshape(classes, k)
    return beta - beta.mean(axis=0), loglik


def pair_correlation(rows: DataFrame, first: tuple[str, str], second: tuple[str, str], step: float = 0.1) -> float:
    """The correlation of two probit outcomes (y, eta) given their linear predictors, by maximum likelihood.

    Predictors are rounded to a step and counted with the outcomes, so the
    driver searches over a table of bounded size, by golden section.
    """
    (y1, e1), (y2, e2) = first, second
    bounded = lambda c: F.bround(F.greatest(F.least(F.col(c), F.lit(4.0)), F.lit(-4.0)) / step) * step
    cells = rows.groupBy(F.col(y1).alias("a"), F.col(y2).alias("b"), bounded(e1).alias("h"), bounded(e2).alias("k")).count().collect()

    def loss(rho: float) -> float:
        total = 0.0
        for a, b, h, k, n in cells:
            # A sign turned is an outcome turned.
            s, t = (1 if a else -1), (1 if b else -1)
            total -= n * np.log(max(bivariate_normal_cdf(s * h, t * k, s * t * rho, 24), 1e-12))
        return total

    low, high, golden = -0.99, 0.99, (np.sqrt(5) - 1) / 2
    a, b = high - golden * (high - low), low + golden * (high - low)
    fa, fb = loss(a), loss(b)
    while high - low > 1e-3:
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - golden * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + golden * (high - low)
            fb = loss(b)
    return float((low + high) / 2)


class FieldBasis:
    """Products of sine functions over x, y and time, scaled by a Matérn spectral density; evaluated anywhere."""

    def __init__(self, centre: tuple[float, float, float], half: tuple[float, float, float], scales: tuple[float, float], sizes: tuple[int, int, int]):
        self.centre, self.half, self.scales, self.sizes = centre, half, scales, sizes
        omega = [np.pi * np.arange(1, m + 1) / (2 * h) for m, h in zip(sizes, half)]
        space = np.sqrt(omega[0][:, None] ** 2 + omega[1][None, :] ** 2)
        self.root = np.sqrt(spectral_density(space, scales[0], 2)[:, :, None] * spectral_density(omega[2], scales[1], 1)[None, None, :]).ravel()

    def at(self, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
        parts = [sine_basis(np.asarray(v, float), h, c, m) for v, h, c, m in zip((x, y, t), self.half, self.centre, self.sizes)]
        return np.einsum("ni,nj,nk->nijk", *parts).reshape(len(parts[0]), -1) * self.root

    def names(self) -> list[str]:
        return [f"b{i}" for i in range(len(self.root))]


def with_basis(rows: DataFrame, basis: FieldBasis, x: str, y: str, t: str) -> DataFrame:
    """rows with a column for each basis function; places and times that repeat are evaluated once."""
    names = basis.names()
    places = rows.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(t).cast("double").alias("_t")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(basis.at(pdf["_x"], pdf["_y"], pdf["_t"]), columns=names)], axis=1)

    made = places.mapInPandas(run, "_x double, _y double, _t double, " + ", ".join(f"{n} double" for n in names))
    same = rows[x].cast("double").eqNullSafe(made["_x"]) & rows[y].cast("double").eqNullSafe(made["_y"]) & rows[t].cast("double").eqNullSafe(made["_t"])
    return rows.join(made, same).drop("_x", "_y", "_t")


def predicted(grid: DataFrame, basis: FieldBasis, x: str, y: str, t: str, beta: np.ndarray, covariance: np.ndarray) -> DataFrame:
    """grid with mean and sd of the field at its points."""
    factor = np.linalg.cholesky(covariance + 1e-12 * np.eye(len(beta)))

    @F.pandas_udf("mean double, sd double")
    def run(px: pd.Series, py: pd.Series, pt: pd.Series) -> pd.DataFrame:
        b = basis.at(px, py, pt)
        return pd.DataFrame({"mean": b @ beta, "sd": np.sqrt(np.sum((b @ factor) ** 2, axis=1))})

    return grid.withColumn("_f", run(F.col(x).cast("double"), F.col(y).cast("double"), F.col(t).cast("double"))).select("*", "_f.mean", "_f.sd").drop("_f")


def lattice(box: tuple[float, float, float, float], step: float, bins: Sequence[int], spark) -> DataFrame:
    """(cell, lon, lat, bin): centres of the cells of a box in every bin; made by sequences, not by a join."""
    west, south, east, north = box
    across, up = round((east - west) / step), round((north - south) / step)
    cells = spark.range(across * up).select(F.col("id").alias("cell"), (F.lit(west) + (F.col("id") % across + 0.5) * step).alias("lon"), (F.lit(south) + (F.floor(F.col("id") / across) + 0.5) * step).alias("lat"))
    return cells.select("*", F.explode(F.array(*(F.lit(int(b)) for b in bins))).alias("bin"))


def reliabilities(scored: DataFrame, source: str, observed: str, expected: str) -> DataFrame:
    """By source: dispersion, its reliability 1 / (1 + dispersion), and squared weights that average to 1."""
    d = scored.groupBy(source).agg(F.avg(F.pow(F.col(observed) - F.col(expected), 2) / F.greatest(F.col(expected), F.lit(1e-12))).alias("dispersion"))
    d = d.withColumn("reliability", 1 / (1 + F.col("dispersion")))
    # One row a source.
    return d.withColumn("weight", F.pow("reliability", 2) / F.avg(F.pow("reliability", 2)).over(Window.partitionBy(F.lit(0))))


def model_ladder(rows: DataFrame, models: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], fold: str, folds: int, cluster: str) -> DataFrame:
    """(model, loss, difference): log loss in bits of each model on held-out folds, and against the first.

    A model takes training and held-out rows and gives (cluster, y, p) of the latter.
    """
    parts = []
    for name, model in models.items():
        for i in range(folds):
            scored = model(rows.filter(F.col(fold) != i), rows.filter(F.col(fold) == i))
            p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-12)), F.lit(1e-12))
            parts.append(scored.groupBy(cluster).agg(F.sum(-(F.col("y") * F.log2(p) + (1 - F.col("y")) * F.log2(1 - p))).alias("loss"), F.count("*").alias("n")).withColumn("model", F.lit(name)))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    by = union.groupBy("model").agg((F.sum("loss") / F.sum("n")).alias("loss"))
    first = next(iter(models))
    base = F.max(F.when(F.col("model") == first, F.col("loss"))).over(Window.partitionBy(F.lit(0)))  # one row a model
    return by.withColumn("difference", F.col("loss") - base)


def support_classes(cells: DataFrame, near_coast_km: float = 50.0) -> DataFrame:
    """cells (inside, coast_km) with the class of evidence they can hold: land, coast, sea near or far."""
    near = F.col("coast_km") <= near_coast_km
    return cells.withColumn("support", F.when(F.col("inside") & near, "coast").when(F.col("inside"), "land").when(near, "near sea").otherwise("far sea"))
