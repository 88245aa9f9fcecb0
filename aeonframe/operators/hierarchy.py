"""Places in hierarchies: folding children into parents, merging names of one place, slugs, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .steps import written


def language_maps(records: DataFrame, key: str, code: str) -> DataFrame:
    """(key, n, counts, main): records, a map of code counts, and the most frequent code (the least of equal ones)."""
    c = records.groupBy(key, code).agg(F.count("*").alias("c"))
    entries = F.sort_array(F.collect_list(F.when(F.col(code).isNotNull(), F.struct(F.col(code).alias("k"), F.col("c").alias("v")))))
    main = F.min(F.when(F.col(code).isNotNull(), F.struct((-F.col("c")).alias("c"), F.col(code).alias("k"))))
    return c.groupBy(key).agg(F.sum("c").alias("n"), F.map_from_entries(entries).alias("counts"), main["k"].alias("main"))


def folded(places: DataFrame, key: str, parent: str, sums: list[str], lows: list[str], highs: list[str]) -> DataFrame:
    """Places with their children folded in: sums, least and greatest values, and how many rows were rolled up."""
    head = F.coalesce(F.col(parent), F.col(key)).alias(key)
    parts = [F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in lows] + [F.max(c).alias(c) for c in highs]
    return places.groupBy(head).agg(*parts, F.count("*").alias("rolled"))


def merge_names(places: DataFrame, key: str, group: str, variants: str) -> DataFrame:
    """Pairs (u, v) of places of one group that share a name variant, each with the least key that shares it.

    Stars instead of all pairs; connected components of them are the places.
    """
    named = places.select(key, group, F.explode(F.array_distinct(variants)).alias("_variant"))
    least = F.min(key).over(Window.partitionBy(group, "_variant"))
    return named.select(least.alias("u"), F.col(key).alias("v")).filter("u < v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of pairs (u, v); component is the least node that is reached.

    Each round hooks a node to its least neighbour and carries the pairs over;
    what a round leaves is written to the shared folder, so that no plan grows.
    """
    both = pairs.select("u", "v").union(pairs.select("v", "u")).toDF("a", "b").filter("a <> b").distinct()
    both, labels = written(both), None
    while not both.isEmpty():
        hook = written(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("to")))
        if labels is None:
            labels = hook.toDF("node", "component")
        else:
            labels = labels.join(hook, labels["component"] == hook["a"], "left").select("node", F.coalesce("to", "component").alias("component"))
        there = hook.toDF("b", "to_b")
        both = written(both.join(hook, "a").join(there, "b").filter("to <> to_b").select("to", "to_b").distinct().toDF("a", "b"))
    return both.toDF("node", "component") if labels is None else labels


def keepers(places: DataFrame, component: str, name: str, key: str) -> DataFrame:
    """By component: the place with the longest name (then the least key), and the other names."""
    best = F.max(F.struct(F.length(name).alias("len"), (-F.col(key)).alias("neg"), F.col(name).alias("name")))
    g = places.groupBy(component).agg(best.alias("b"), F.array_sort(F.collect_set(name)).alias("names"), F.count("*").alias("n_places"))
    return g.select(component, (-F.col("b.neg")).alias(key), F.col("b.name").alias(name), F.array_remove("names", F.col("b.name")).alias("aliases"), "n_places")


def unique_slugs(places: DataFrame, key: str, slug: str, region: str) -> DataFrame:
    """places with unique: the slug; if taken, with the region; if that is taken too, with a hash of the key."""
    first = F.row_number().over(Window.partitionBy(slug).orderBy(key))
    with_region = F.concat_ws("-", slug, F.col(region).cast("string"))
    step = places.withColumn("_s", F.when(first == 1, F.col(slug)).otherwise(with_region))
    second = F.row_number().over(Window.partitionBy("_s").orderBy(key))
    return step.withColumn("unique", F.when(second == 1, F.col("_s")).otherwise(F.concat_ws("-", "_s", F.substring(F.sha1(F.col(key).cast("string").cast("binary")), 1, 6)))).drop("_s")


def dictionary(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(value, code): codes in the order in which values are first seen by key; '' and null are 0."""
    seen = rows.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.min(key).alias("_first"))
    # One row for each different value.
    return seen.select("value", F.row_number().over(Window.orderBy("_first", "value")).alias("code"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order, as an upsert leaves it."""
    by = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
