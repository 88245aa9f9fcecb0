"""Weighted entropies of an outcome, plain and held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from aeonframe.functions.scalars import entropy_bits


def cells(rows: DataFrame, keys: list[str], y: str, w: str) -> DataFrame:
    """By keys: mass and share of the outcome."""
    return rows.groupBy(*keys).agg(F.sum(w).alias("mass"), (F.sum(F.col(y) * F.col(w)) / F.sum(w)).alias("share"))


def conditional(rows: DataFrame, keys: list[str], y: str, w: str) -> DataFrame:
    """One row (bits, mass): the entropy of a binary outcome within cells, weighted by their mass."""
    c = cells(rows, keys, y, w)
    return c.agg((F.sum(F.col("mass") * entropy_bits(F.col("share"))) / F.sum("mass")).alias("bits"), F.sum("mass").alias("mass"))


def held_out(rows: DataFrame, keys: list[str], y: str, w: str, fold: str, alpha: float = 2.0) -> DataFrame:
    """One row (bits): log loss of each fold under the cell shares of the others, drawn to their overall rate by alpha.

    Sums by cell and fold are made once; what a fold may know is the total
    less its own, so the data is read once however many folds there are.
    """
    c = rows.groupBy(fold, *keys).agg(F.sum(w).alias("n"), F.sum(F.col(y) * F.col(w)).alias("s"))
    by_cell, by_fold = Window.partitionBy(*keys), Window.partitionBy(fold)
    c = c.withColumns({"cell_n": F.sum("n").over(by_cell), "cell_s": F.sum("s").over(by_cell), "fold_n": F.sum("n").over(by_fold), "fold_s": F.sum("s").over(by_fold)})
    total = c.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    c = c.crossJoin(F.broadcast(total))  # one row
    rate = (F.col("all_s") - F.col("fold_s")) / (F.col("all_n") - F.col("fold_n"))
    p = (F.col("cell_s") - F.col("s") + alpha * rate) / (F.col("cell_n") - F.col("n") + alpha)
    p = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    loss = -(F.col("s") * F.log2(p) + (F.col("n") - F.col("s")) * F.log2(1 - p))
    return c.agg((F.sum(loss) / F.sum("n")).alias("bits"))


def of_codes(rows: DataFrame, keys: list[str], code: str, least: int = 1) -> DataFrame:
    """By keys with so many rows at least: n and the entropy in bits of a code's shares."""
    c = rows.groupBy(*keys, code).agg(F.count("*").alias("c"))
    c = c.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*keys)))
    return c.groupBy(*keys).agg(F.sum("c").alias("n"), (-F.sum(F.col("p") * F.log2("p"))).alias("bits")).filter(F.col("n") >= least)
