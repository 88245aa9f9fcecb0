"""Validation metrics, folds, cluster bootstrap, and penalised models from distributed sufficient statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def fold_of(key: Column | str, folds: int, seed: int = 0) -> Column:
    """A fold by the hash of a cluster, so a cluster is never split."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def balanced_folds(rows: DataFrame, key: str, folds: int) -> DataFrame:
    """(key, fold): clusters dealt in turn in the order of a hash; numbers of clusters differ by one at most."""
    clusters = rows.select(key).distinct()
    place = F.row_number().over(Window.orderBy(F.xxhash64(key), key)) - 1  # one row a cluster
    return clusters.withColumn("fold", (place % folds).cast("int"))


def binary_metrics(scored: DataFrame, y: str, p: str, threshold: float = 0.5, digits: int = 6) -> DataFrame:
    """One row: n, auc, average_precision, f1, balanced_accuracy, brier, log_loss_bits of outcomes y (0, 1) and chances p.

    Everything comes from counts at each different p, summed before the one
    sort, in which ties share their mean rank; average precision takes equal
    p's together. Chances are rounded to `digits` places, so the sort has
    10**digits rows at most.
    """
    scored = scored.withColumn(p, F.round(F.col(p), digits))
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-12)), F.lit(1e-12))
    at = scored.groupBy(F.col(p).alias("p")).agg(
        F.count("*").alias("n"), F.sum(y).alias("pos"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("sq"), F.sum(-(F.col(y) * F.log2(q) + (1 - F.col(y)) * F.log2(1 - q))).alias("loss")
    )
    up = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"below": F.coalesce(F.sum(F.col("n") - F.col("pos")).over(up), F.lit(0)), "tp": F.sum("pos").over(down), "seen": F.sum("n").over(down)})
    hit = F.col("p") >= threshold
    s = at.agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2)).alias("u"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("ap"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"), F.sum("sq").alias("sq"), F.sum("loss").alias("loss"),
    )
    neg = F.col("n") - F.col("pos")
    return s.select(
        "n", F.try_divide("u", F.col("pos") * neg).alias("auc"), F.try_divide("ap", F.col("pos")).alias("average_precision"), F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")).alias("f1"),
        ((F.try_divide("tp", F.col("pos")) + F.try_divide(neg - F.col("fp"), neg)) / 2).alias("balanced_accuracy"), (F.col("sq") / F.col("n")).alias("brier"), (F.col("loss") / F.col("n")).alias("log_loss_bits"),
    )


def _drawn(batches: Iterator[pd.DataFrame], by: list[str], sums: list[str], draws: int, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
    """The weighted sums of each batch by keys and draw."""
    steps = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for pdf in batches:
        if not len(pdf):
            continue
        u = pdf["_h"].to_numpy(np.int64).view(np.uint64)[:, None] + steps
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            u = (u ^ (u >> np.uint64(shift))) * np.uint64(factor)
        u = ((u ^ (u >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
        weights = np.searchsorted(cuts, u)
        group = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(pdf), np.int64)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        keys = pdf[by].iloc[order[starts]].reset_index(drop=True)
        out = keys.loc[keys.index.repeat(draws)].reset_index(drop=True) if by else pd.DataFrame(index=range(draws))
        out["draw"] = np.tile(np.arange(draws, dtype=np.int32), len(starts))
        for s in sums:
            out[s] = np.add.reduceat(weights[order] * pdf[s].to_numpy(float)[order, None], starts, axis=0).ravel()
        yield out


def cluster_bootstrap(cells: DataFrame, cluster: str, sums: list[str], by: list[str], statistic: Callable[..., Column], draws: int = 200, seed: int = 0) -> DataFrame:
    """By keys: the statistic of the sums, and its 2.5 % and 97.5 % points when clusters are drawn anew.

    cells: sums by cluster and keys. A draw gives each cluster a Poisson(1)
    weight from a hash of the cluster and the draw, which is resampling with
    replacement up to the number drawn; all draws are made in one
    read of the cells: a batch gives one row for each key and draw, and no cell
    is copied.
    """
    cuts, term, total = [], np.exp(-1.0), 0.0
    for k in range(12):
        total += term
        cuts.append(total)
        term /= k + 1
    kept = cells.select(*by, *(F.col(s).cast("double").alias(s) for s in sums), F.xxhash64(F.col(cluster), F.lit(seed)).alias("_h"))
    schema = T.StructType([*(kept.schema[c] for c in by), T.StructField("draw", T.IntegerType()), *(T.StructField(s, T.DoubleType()) for s in sums)])
    weighed = kept.mapInPandas(lambda batches: _drawn(batches, by, sums, draws, np.array(cuts)), schema)
    each = weighed.groupBy(*by, "draw").agg(*(F.sum(s).alias(s) for s in sums))
    each = each.withColumn("stat", statistic(*(F.col(s) for s in sums)))
    band = each.groupBy(*by).agg(F.percentile("stat", 0.025).alias("low"), F.percentile("stat", 0.975).alias("high"), F.stddev("stat").alias("se"))
    whole = cells.groupBy(*by).agg(*(F.sum(s).alias(s) for s in sums)).withColumn("estimate", statistic(*(F.col(s) for s in sums)))
    return whole.join(band, by, "left").select(*by, "estimate", "low", "high", "se") if by else whole.crossJoin(F.broadcast(band)).select("estimate", "low", "high", "se")


def _sums(batches: Iterator[pd.DataFrame], columns: list[str], y: str, w: str, beta: np.ndarray, link: str) -> Iterator[pd.DataFrame]:
    """X'WX, X'Wz and the log likelihood of a partition, in one row."""
    k = len(columns)
    a, b, loglik = np.zeros((k, k)), np.zeros(k), 0.0
    for pdf in batches:
        x, t, v = pdf[columns].to_numpy(float), pdf[y].to_numpy(float), pdf[w].to_numpy(float)
        eta = x @ beta
        if link == "logit":
            p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
            slope = p * (1 - p)
        else:
            z = np.clip(eta, -8, 8)
            slope = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
            p = np.clip(_normal_cdf(z), 1e-12, 1 - 1e-12)
        variance = np.maximum(p * (1 - p), 1e-12)
        weight = v * slope**2 / variance
        a += x.T @ (x * weight[:, None])
        b += x.T @ (v * slope / variance * (t - p))
        p = np.clip(p, 1e-12, 1 - 1e-12)
        loglik += float(np.sum(v * (t * np.log(p) + (1 - t) * np.log(1 - p))))
    yield pd.DataFrame({"a": [a.ravel().tolist()], "b": [b.tolist()], "loglik": [loglik]})


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + 0.2316419 * np.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * poly
    return np.where(x >= 0, 1 - upper, upper)


def fit_binary(rows: DataFrame, columns: list[str], y: str, w: str, penalty: np.ndarray, link: str = "logit", rounds: int = 25, tolerance: float = 1e-8, start: np.ndarray | None = None, most_step: float = 2.0) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, log likelihood and inverse Hessian of a penalised weighted logit or probit.

    Iteratively reweighted least squares: each round reads the rows once,
    partitions send k * k sums, and the driver solves a k by k system. penalty
    is a k by k matrix. Steps are capped.
    """
    k = len(columns)
    beta = np.zeros(k) if start is None else start.copy()
    slim = rows.select(*columns, y, w)
    loglik, hessian = 0.0, penalty
    for _ in range(rounds):
        at = beta.copy()
        parts = slim.mapInPandas(lambda it, at=at: _sums(it, columns, y, w, at, link), "a array<double>, b array<double>, loglik double")
        # The parts are summed on the executors, element by element.
        total = parts.select(F.posexplode(F.concat("a", "b", F.array("loglik")))).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()
        v = np.array([r["v"] for r in total])
        hessian = v[: k * k].reshape(k, k) + penalty
        step = np.linalg.solve(hessian, v[k * k : k * k + k] - penalty @ beta)
        loglik = float(v[-1])
        beta = beta + np.clip(step, -most_step, most_step)
        if np.max(np.abs(step)) < tolerance:
            break
    return beta, loglik, np.linalg.inv(hessian)


def em_latent_bin(expanded: DataFrame, record: str, columns: list[str], y: str, w: str, penalty: np.ndarray, rounds: int = 20, tolerance: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """Coefficients and log likelihoods of a logit whose bin is unknown: EM over the bins a record could be of.

    expanded: a row for each record and bin with its prior weight w. The
    E-step weighs a record's bins by prior times likelihood, in a window over
    the record; the M-step is a weighted fit.
    """
    beta, found = np.zeros(len(columns)), []
    for _ in range(rounds):
        eta = sum((F.col(c) * float(b) for c, b in zip(columns, beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        like = F.col(w) * F.when(F.col(y) == 1, p).otherwise(1 - p)
        scored = expanded.withColumn("_like", like).withColumn("_total", F.sum("_like").over(Window.partitionBy(record)))
        post = scored.withColumn("_post", F.col("_like") / F.col("_total"))
        loglik = scored.groupBy(record).agg(F.first("_total").alias("t")).agg(F.sum(F.log("t"))).first()[0]
        found.append(float(loglik))
        if len(found) > 1 and abs(found[-1] - found[-2]) < tolerance * (1 + abs(found[-1])):
            break
        beta, _, _ = fit_binary(post, columns, y, "_post", penalty, rounds=4, start=beta)
    return beta, found


def second_difference_penalty(n: int) -> np.ndarray:
    """Of a smooth curve over n ordered bins: the sum of squared second differences."""
    d = np.zeros((max(n - 2, 0), n))
    for i in range(n - 2):
        d[i, i : i + 3] = 1, -2, 1
    return d.T @ d


def spectral_density(omega: np.ndarray, scale: float, dimensions: int = 1, nu: float = 1.5) -> np.ndarray:
    """Of a Matérn process with variance 1."""
    from math import gamma, pi

    base = 2 * nu / scale**2
    constant = 2**dimensions * pi ** (dimensions / 2) * gamma(nu + dimensions / 2) * (2 * nu) ** nu / (gamma(nu) * scale ** (2 * nu))
    return constant * (base + omega**2) ** -(nu + dimensions / 2)


def sine_basis(x: np.ndarray, half: float, centre: float, m: int) -> np.ndarray:
    """Eigenfunctions of the Laplacian on an interval that is half wide to both sides of its centre."""
    j = np.arange(1, m + 1)
    return np.sqrt(1 / half) * np.sin(np.outer((x - centre + half) / (2 * half), np.pi * j))


def hilbert_basis(rows: DataFrame, x: str, centre: float, half: float, scale: float, m: int) -> DataFrame:
    """rows with basis: m sine functions of a column, each scaled by the root of the spectral density at its frequency."""

    @F.pandas_udf("array<double>")
    def basis(values: pd.Series) -> pd.Series:
        root = np.sqrt(spectral_density(np.pi * np.arange(1, m + 1) / (2 * half), scale))
        return pd.Series(list(sine_basis(values.to_numpy(float), half, centre, m) * root))

    return rows.withColumn("basis", basis(F.col(x).cast("double")))


def owens_t(h: float, a: float, points: int = 64) -> float:
    """Owen's T by Gauss-Legendre quadrature."""
    node, weight = np.polynomial.legendre.leggauss(points)
    x = a * (node + 1) / 2
    return float(np.sum(weight * np.exp(-(h**2) * (1 + x**2) / 2) / (1 + x**2)) * a / 2 / (2 * np.pi))


def bivariate_normal_cdf(h: float, k: float, rho: float, points: int = 64) -> float:
    """P(X <= h, Y <= k) of standard normals of correlation rho: Plackett's integral over the correlation."""
    node, weight = np.polynomial.legendre.leggauss(points)
    r = rho * (node + 1) / 2
    density = np.exp(-(h * h - 2 * r * h * k + k * k) / (2 * (1 - r * r))) / (2 * np.pi * np.sqrt(1 - r * r))
    return float(_exact_cdf(h) * _exact_cdf(k) + np.sum(weight * density) * rho / 2)


def _exact_cdf(x: float) -> float:
    from math import erf, sqrt

    return 0.5 * (1 + erf(x / sqrt(2)))
