"""Writers: tables with their DDL and views, column-major JSON, GeoJSON, timelines, CSV, and stamps of what was built."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def star(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def views(spark: SparkSession, folder: str, names: list[str]) -> None:
    for name in names:
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name)


def ddl(name: str, df: DataFrame) -> str:
    columns = ",\n".join(f"  {f.name} {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema)
    return f"CREATE TABLE {name} (\n{columns}\n)"


def _code(known: Column):
    return lambda v: F.array_position(known, v) - 1


def column_major(df: DataFrame, order: list[str], encoded: list[str] = []) -> DataFrame:  # noqa: B006
    """One row (json): {n, columns, dicts}: each column an array in one order; encoded columns as codes of values in the order seen, 0 for none.

    For payloads that a browser loads whole; rows are gathered in one place.
    """
    rows = df.select(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("o", "r"))).alias("all"))
    columns, dicts = [], []
    for c in df.columns:
        values = F.col("all.r").getField(c)
        if c in encoded:
            plain = F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("")))
            known = F.concat(F.array(F.lit("")), F.filter(F.array_distinct(plain), lambda v: v != ""))
            dicts.append(known.alias(c))
            values = F.transform(plain, _code(known))
        columns.append(values.alias(c))
    parts = [F.size("all").alias("n"), F.struct(*columns).alias("columns")] + ([F.struct(*dicts).alias("dicts")] if dicts else [])
    return one.select(F.to_json(F.struct(*parts)).alias("json"))


def features(df: DataFrame, lon: str, lat: str, order: list) -> DataFrame:
    """(json): a GeoJSON feature for each located row, the other columns as properties, in an order."""
    props = [c for c in df.columns if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    located = df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).orderBy(*order)
    return located.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))).alias("json"))


def feature_collection(df: DataFrame, lon: str, lat: str, order: list, path: str) -> None:
    """A GeoJSON file a partition: lines of features, for layers however large."""
    features(df, lon, lat, order).write.mode("overwrite").text(path)


def csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def grid_payload(grid: DataFrame, cell: str, ordinal: str, value: str, bins: list[int]) -> DataFrame:
    """A row for each cell with an int column for each bin: the value times 100, half to even; nothing is 0."""
    wide = grid.groupBy(cell).pivot(ordinal, bins).agg(F.bround(F.sum(value) * 100).cast("long"))
    return wide.na.fill(0)


def link_rows(matches: DataFrame) -> DataFrame:
    """Links in the fixed order of their columns, score to 3 and distance to 2 places, half to even."""
    return matches.select("place_slug", "place_name", "authority", "identifier", "uri", "label", "method", F.bround("score", 3).alias("score"), F.bround("distance_km", 2).alias("distance_km"))


def fingerprint(tables: dict[str, DataFrame]) -> str:
    """A digest of names, schemas and contents, whatever the order of rows; sums of row hashes are made where the rows are."""
    parts = {}
    for name, df in sorted(tables.items()):
        h = F.xxhash64(*df.columns)
        n, a, b = df.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 40))), F.sum(F.pmod(F.xxhash64(h), F.lit(1 << 40)))).first()
        parts[name] = [df.schema.simpleString(), n, a, b]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def is_stale(spark: SparkSession, stamp_path: str, digest: str) -> bool:
    """Whether what was built (stamp) was built from something else, or never."""
    try:
        held = spark.read.text(stamp_path).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return True
    return held is None or held.value != digest


def stamp(spark: SparkSession, stamp_path: str, digest: str) -> None:
    spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(stamp_path)
