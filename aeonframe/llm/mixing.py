"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import persisted, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
RANK_BINS = 1 << 12


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row a source.

    Sources in code point order, null last, weigh as in weights, repeating.
    They share the sum of all sizes by weight; none gets more than most times
    its size, and what is above goes to the others by weight. All who are
    capped come first in the order of most * size / weight, so one pass in
    that order finds the common level.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    # One row for each source stands here, not for each document.
    weighed = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level)
    # The level stands still from the first source that isn't capped on; before, it is above each cap.
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(whole)
    return leveled.withColumn("at", first["level"]).select("source", F.col("source_size"), F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def pareto_key(inclusion: Column, *identity: Column | str) -> Column:
    """Random odds over inclusion odds; the least keys are taken. The same identity always gets the same key."""
    uniform = (F.shiftrightunsigned(F.xxhash64(*identity, F.lit("pareto order")), 11).cast("double") + 0.5) / float(1 << 53)
    return F.try_divide(uniform / (1 - uniform), F.try_divide(inclusion, 1 - inclusion))


def mixed(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """documents with size, source_size, target, copies and taken (copies times size).

    A document's expected number of copies is its source's target over the
    source's size, at most `most`. The whole part of it is allocated for
    certain; the rest is its inclusion probability for one copy more, decided
    by Pareto order sampling: documents are ranked by random odds divided by
    inclusion odds, and the first ones are taken whose words together come
    nearest to what the source still lacks. The sample is fixed in words, so a
    source misses its target by at most half a document.

    The size is the number of words (runs of other than space and \\t \\n \\v \\f
    \\r), 0 for a null text. Rows without a source are a source of their own,
    the last. Rows with the same doc_id and text get the same rank and go
    together. A source without words takes nothing (its copies are 0). Columns
    of documents that have one of the names added are replaced.

    Thresholds come from sums of words by rank bin, then from the rows of one
    bin a source, so no task holds a whole source.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    docs = documents.drop(*added).withColumn("size", words_of(F.col("text").cast("string")))
    identity = [F.col("doc_id"), F.xxhash64(F.col("text").cast("string"))]
    uniform = (F.shiftrightunsigned(F.xxhash64(*identity, F.lit("pareto order")), 11).cast("double") + 0.5) / float(1 << 53)
    slim = persisted(docs.select(F.col("source"), "size", *(c.alias(f"i{n}") for n, c in enumerate(identity)), F.floor(uniform * RANK_BINS).alias("bin")), "mixing-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("expected", expected).withColumn("certain", F.floor("expected")).withColumn("inclusion", F.col("expected") - F.col("certain"))
    targets = persisted(targets.withColumn("lacks", F.col("target") - F.col("certain") * F.col("source_size")), "mixing-targets")

    # Within a source keys rise with the uniform number, so bins of that are bins of the rank.
    def beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return left.join(right, left["source"].eqNullSafe(right["_source"]), how).drop("_source")

    bins = slim.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    ranked = bins.withColumn("until", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
    ranked = beside(ranked, targets.filter("inclusion > 0").select("source", "lacks", "inclusion"))
    crossing = ranked.filter("until - words <= lacks and lacks <= until").groupBy("source").agg(F.min(F.struct("bin", (F.col("until") - F.col("words")).alias("before"), "lacks", "inclusion")).alias("c"))
    crossing = crossing.select("source", F.col("c.bin").alias("at"), "c.before", "c.lacks", "c.inclusion")
    rows = beside(slim, crossing).filter("bin = at").withColumn("key", pareto_key(F.col("inclusion"), "i0", "i1"))
    summed = rows.withColumn("until", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key")))
    nearest = summed.groupBy("source").agg(F.min(F.struct(F.abs(F.col("lacks") - F.col("until")).alias("off"), "key")).alias("n"), F.min("key").alias("first"), F.first(F.col("lacks") - F.col("before")).alias("without"))
    # Taking none of the bin may come nearest; then the cut is before its first key.
    cut = nearest.select("source", F.when(F.col("n.off") <= F.col("without"), F.col("n.key")).alias("last"), "first")
    cuts = persisted(beside(targets, cut, "left"), "mixing-cuts")
    of, at = unused(docs, "_source", "_cut")
    cuts = cuts.select(F.col("source").alias(of), F.struct(*cuts.columns).alias(at))

    placed = docs.join(cuts, docs["source"].eqNullSafe(cuts[of]), "left")
    key = pareto_key(F.col(at)["inclusion"], *identity)
    chosen = F.when(F.col(at)["last"].isNotNull(), key <= F.col(at)["last"]).otherwise(key < F.col(at)["first"])
    more = F.coalesce((F.col(at)["inclusion"] > 0) & chosen, F.lit(False))
    copies = (F.col(at)["certain"] + more.cast("int")).cast("long")
    values = [F.col("size"), F.col(at)["source_size"], F.col(at)["target"], copies, copies * F.col("size")]
    return placed.select(*[docs[c] for c in docs.columns if c != "size"], *(v.alias(name) for v, name in zip(values, added)))
