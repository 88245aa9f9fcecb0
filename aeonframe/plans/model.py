"""The star of records, places and bins over the tables of a folder, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aeonframe.operators.intervals import with_ordinals


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _no_zero(c):
    return F.when(c == 0, F.lit(1)).otherwise(c)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as records: dated to uncertain intervals of signed years, some ends unknown."""
    o = table(spark, folder, "orders")
    first = -800 + (F.col("o_orderkey") * 37) % 880
    last = first + (F.col("o_custkey") * 13) % 300
    return o.select(
        F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("place_id"), F.col("o_orderpriority").alias("language"), F.col("o_orderstatus").alias("script"), F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderkey") % 13 != 0, _no_zero(first)).cast("int").alias("date_start"), F.when(F.col("o_orderkey") % 11 != 0, _no_zero(last)).cast("int").alias("date_end"),
    )


def dated(spark: SparkSession, folder: str) -> DataFrame:
    return with_ordinals(records(spark, folder))


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as places on a map of Italy's size; every tenth is the parent of the nine after it."""
    c = table(spark, folder, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("place_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("region"),
        ((key * 7919) % 1000 / F.lit(100.0) + 36).alias("lat"), ((key * 104729) % 1100 / F.lit(100.0) + 7).alias("lon"),
        F.when(key % 10 != 0, key - key % 10).alias("parent_id"), F.col("c_acctbal").alias("value"),
    )


RECORDS = """
records AS (
  SELECT o_orderkey AS pk, o_custkey AS place_id, o_orderpriority AS language, o_orderstatus AS script, o_totalprice AS value,
         CASE WHEN o_orderkey % 13 <> 0 THEN CASE WHEN s = 0 THEN 1 ELSE s END END AS date_start,
         CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN s + w = 0 THEN 1 ELSE s + w END END AS date_end
  FROM (SELECT *, -800 + (o_orderkey * 37) % 880 AS s, (o_custkey * 13) % 300 AS w FROM orders))"""
EDGE = "CASE WHEN {y} < 0 THEN -(((-{y} + 24) // 25) * 25) ELSE CAST(floor(({y} - 1) / 25.0) AS BIGINT) * 25 + 1 END"
ORD = "CASE WHEN {y} < 0 THEN -((-{y} + 24) // 25) ELSE CAST(floor(({y} - 1) / 25.0) AS BIGINT) END"
DATED = (
    RECORDS
    + """,
ends AS (SELECT *, least(coalesce(date_start, date_end), coalesce(date_end, date_start)) AS a, greatest(coalesce(date_start, date_end), coalesce(date_end, date_start)) AS b FROM records),
ords AS (SELECT *, """
    + ORD.format(y="a")
    + " AS ord_start, "
    + ORD.format(y="b")
    + """ AS ord_last FROM ends),
dated AS (SELECT * EXCLUDE (ord_last), least(ord_last, ord_start + 399) AS ord_end, least(ord_last, ord_start + 399) - ord_start + 1 AS n_bins FROM ords)"""
)
EXPANDED = (
    DATED
    + """,
expanded AS (SELECT *, unnest(generate_series(ord_start, ord_end)) AS ord, 1.0::DOUBLE / n_bins AS w FROM dated WHERE ord_start IS NOT NULL)"""
)
PLACES = """
places AS (
  SELECT c_custkey AS place_id, c_name AS name, c_nationkey AS region, (c_custkey * 7919) % 1000 / 100.0::DOUBLE + 36 AS lat, (c_custkey * 104729) % 1100 / 100.0::DOUBLE + 7 AS lon,
         CASE WHEN c_custkey % 10 <> 0 THEN c_custkey - c_custkey % 10 END AS parent_id, c_acctbal AS value FROM customer)"""
