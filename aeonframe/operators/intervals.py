"""Expansion of uncertain intervals over time bins, and what is summed over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeonframe.functions import scalars as S

MOST_BINS = 400


def with_ordinals(records: DataFrame, start: str = "date_start", end: str = "date_end") -> DataFrame:
    """records with ord_start, ord_end and n_bins of their interval.

    A missing end is the other one; ends the wrong way round are swapped;
    records without any have nulls. An interval has MOST_BINS bins at most.
    """
    # least and greatest skip nulls, so a missing end is the other one.
    first, last = S.year_ordinal(F.least(start, end)), S.year_ordinal(F.greatest(start, end))
    placed = records.withColumns({"ord_start": first, "ord_end": last})
    placed = placed.withColumn("ord_end", F.least("ord_end", F.col("ord_start") + MOST_BINS - 1))
    return placed.withColumn("n_bins", F.col("ord_end") - F.col("ord_start") + 1)


def expand(records: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """A row for each bin of each dated record: ord, and the weight w = 1 / n_bins.

    Bins outside low..high are left out, but the weight keeps the whole width,
    so a record that reaches beyond the axis sums to less than 1. Written as
    an explode of a sequence, which is linear in what it makes, where a join
    with BETWEEN would compare every record with every bin.
    """
    a = F.col("ord_start") if low is None else F.greatest("ord_start", F.lit(low))
    b = F.col("ord_end") if high is None else F.least("ord_end", F.lit(high))
    rows = records.filter(F.col("ord_start").isNotNull())
    # A filter on a and b, or the one on empty sequences that a plain explode brings, would go down to the scan
    # with all that makes them put in many times over; what explode_outer makes is filtered after it.
    if low is None and high is None:
        rows = rows.withColumn("ord", F.explode_outer(F.sequence(a, b)))
    else:
        rows = rows.withColumn("ord", F.explode_outer(F.when(a <= b, F.sequence(a, b)))).filter("ord is not null")
    return rows.withColumn("w", F.lit(1.0) / F.col("n_bins"))


def counted(records: DataFrame, *by: str) -> DataFrame:
    """Records of equal keys and bins as one row, with their number `records`.

    Intervals of some hundred bins are few, however many records there are, so
    sums over bins expand these rows and not the records.
    """
    same = records.filter("ord_start is not null").groupBy(*by, "ord_start", "ord_end").agg(F.count("*").alias("records"))
    return same.withColumn("n_bins", F.col("ord_end") - F.col("ord_start") + 1)


def axis(records: DataFrame, least: float = 0.5) -> DataFrame:
    """(ord, edge, label): from the first to the last bin that has weight `least` or a start."""
    weight = expand(counted(records)).groupBy("ord").agg(F.sum(F.col("w") * F.col("records")).alias("w")).filter(F.col("w") >= least).select("ord")
    seen = weight.union(records.filter("ord_start is not null").select("ord_start"))
    ends = seen.agg(F.min("ord").alias("a"), F.max("ord").alias("b")).filter("a is not null")
    bins = ends.select(F.explode(F.sequence("a", "b")).alias("ord"))
    edge = S.ordinal_edge(F.col("ord"))
    return bins.select("ord", edge.alias("edge"), S.bin_label(edge).alias("label"))


def timeline(records: DataFrame, *by: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """By keys and bin: how many records could be of it, how many are expected, and the standard deviation.

    A record is of a bin with chance w, so the count is Poisson-binomial: its
    expectation is the sum of w, its variance the sum of w (1 - w).
    """
    rows = expand(counted(records, *by), low, high).groupBy(*by, "ord")
    w, n = F.col("w"), F.col("records")
    return rows.agg(F.sum(n).alias("possible"), F.sum(n * w).alias("expected"), F.sqrt(F.sum(n * w * (1 - w))).alias("sd"))


def start_timeline(records: DataFrame, *by: str) -> DataFrame:
    """By keys and first bin: how many records."""
    return records.filter("ord_start is not null").groupBy(*by, F.col("ord_start").alias("ord")).agg(F.count("*").alias("n"))


def overlap_weights(intervals: DataFrame, start: str, end: str, kind: str, width: int = S.BIN_YEARS, keep: float = 1e-9) -> DataFrame:
    """Rows (bin_start, weight) of each interval's overlap with bins of that width.

    kind 'event': the share of the interval that falls in the bin; 'presence':
    the share of the bin that the interval covers. An end not after its start
    is the start and a year more. Overlaps of keep or less are left out.
    """
    lo = F.col(start).cast("double")
    hi = F.when(F.col(end) <= F.col(start), F.col(start) + 1).otherwise(F.col(end)).cast("double")
    first, last = F.floor(lo / width).cast("int"), F.floor(hi / width).cast("int")
    rows = intervals.filter(lo.isNotNull() & hi.isNotNull()).withColumn("_b", F.explode(F.sequence(first, last)))
    over = F.greatest(F.least(hi, (F.col("_b") + 1) * F.lit(float(width))) - F.greatest(lo, F.col("_b") * F.lit(float(width))), F.lit(0.0))
    weight = over / ((hi - lo) if kind == "event" else F.lit(float(width)))
    return rows.withColumn("bin_start", F.col("_b") * width).withColumn("weight", weight).filter(F.col("weight") > keep).drop("_b")


def merged_runs(periods: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals of a key that touch or overlap, as one."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = periods.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_periods")).drop("_run")


def heaping_halfwidth(records: DataFrame, year: str, few: int = 5, many: int = 50, halfwidths: tuple[int, int, int] = (5, 12, 25)) -> DataFrame:
    """records with halfwidth: the more often a year is repeated, the less it is believed."""
    n = F.count("*").over(Window.partitionBy(year))
    return records.withColumn("halfwidth", F.when(n <= few, halfwidths[0]).when(n <= many, halfwidths[1]).otherwise(halfwidths[2]))


def interpolate(series: DataFrame, key: str, ordinal: str, value: str, at: Column) -> DataFrame:
    """series with the value at a fraction of the way to the next bin of its key (the last stays)."""
    following = F.lead(value).over(Window.partitionBy(key).orderBy(ordinal))
    return series.withColumn("interpolated", F.col(value) + at * (F.coalesce(following, F.col(value)) - F.col(value)))
