"""Readers: dirty delimited files, GeoJSON and NDJSON layers, gazetteer archives, shapefiles, XML, scraped pages, YAML tables."""

from __future__ import annotations

import csv
import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aeonframe.functions import scalars as S
from aeonframe.functions.unicode import looks_damaged, repair


def delimited(spark: SparkSession, path: str, columns: dict[str, str], repaired: bool = True) -> tuple[DataFrame, list[str]]:
    """A CSV file of mixed encodings as text columns, and warnings.

    Bytes are read as Latin-1, so none is lost; damaged UTF-8 is repaired.
    columns: header to name. Headers that are missing become null columns;
    headers not asked for are left out; both are told in the warnings. Short
    rows are filled up with nulls, long ones cut; rows without any value go.
    """
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    have = {c.strip().lstrip("﻿").replace("ï»¿", ""): c for c in raw.columns}
    warnings = [f"missing column {h}" for h in columns if h not in have] + [f"unknown column {h}" for h in have if h not in columns]
    named = raw.select(*(F.col(f"`{have[h]}`").alias(n) if h in have else F.lit(None).cast("string").alias(n) for h, n in columns.items()))
    if repaired:
        # The repair runs only on values that are not plain ASCII.
        named = named.select(*(F.when(F.col(c).rlike("[^\\x00-\\x7F]"), repair(F.col(c))).otherwise(F.col(c)).alias(c) for c in columns.values()))
    cleaned = named.select(*(S.text(F.col(c)).alias(c) for c in columns.values()))
    return cleaned.dropna(how="all"), warnings


def encoding_audit(rows: DataFrame) -> DataFrame:
    """(column, value, n): values that still look damaged, most frequent first."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in rows.columns)))
    bad = rows.select(cells.alias("c")).select("c.*").filter(looks_damaged(F.col("value")))
    # Values may be whole texts: they are grouped by a hash.
    found = bad.groupBy("column", F.sha2("value", 256).alias("hash")).agg(F.first("value").alias("value"), F.count("*").alias("n"))
    return found.drop("hash").orderBy(F.col("n").desc(), "column", "value")


_FEATURES = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def geojson(spark: SparkSession, paths: list[str], box: tuple[float, float, float, float] | None = None, name_fields: tuple[str, ...] = ("name",), need_name: bool = False, rank_field: str | None = None) -> DataFrame:
    """(kind, coordinates, name, props, rank) of the features of some files; coordinates as JSON text.

    With a box (west, south, east, north) only features whose own box meets it.
    Property names are matched whatever their case.
    """
    rows = spark.read.schema(_FEATURES).option("multiLine", True).json(paths).select(F.explode("features").alias("f"))
    name = S.first_property(F.col("f.properties"), *name_fields)
    rank = S.first_property(F.col("f.properties"), rank_field).try_cast("double") if rank_field else F.lit(None).cast("double")
    out = rows.select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), name.alias("name"), F.col("f.properties").alias("props"), rank.alias("rank")).filter("coordinates is not null")
    if need_name:
        out = out.filter("name is not null")
    return in_box(out, box) if box else out


def in_box(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Features (coordinates as JSON text) whose box meets a box; pairs of numbers are read off the text."""
    pairs = F.regexp_extract_all("coordinates", F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)"), F.lit(1))
    xs = F.transform(pairs, lambda p: F.trim(F.element_at(F.split(p, ","), 1)).try_cast("double"))
    ys = F.transform(pairs, lambda p: F.trim(F.element_at(F.split(p, ","), 2)).try_cast("double"))
    west, south, east, north = box
    return features.filter((F.array_max(xs) >= west) & (F.array_min(xs) <= east) & (F.array_max(ys) >= south) & (F.array_min(ys) <= north))


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; lines that aren't are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def zipped_tables(spark: SparkSession, path: str, *fragments: str) -> DataFrame:
    """(member, row, column, value) of CSV members of ZIP archives whose names hold a fragment.

    Archives are read as whole files, one task each.
    """

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for member in z.namelist():
                        if not member.lower().endswith(".csv") or fragments and not any(f.lower() in member.lower() for f in fragments):
                            continue
                        with z.open(member) as f:
                            for n, row in enumerate(csv.DictReader(io.TextIOWrapper(f, "utf-8", errors="replace"))):
                                cells = [(k, v) for k, v in row.items() if k is not None and not isinstance(v, list)]
                                yield pd.DataFrame({"member": member, "row": n, "column": [k for k, _ in cells], "value": [v for _, v in cells]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpacked, "member string, row long, column string, value string")


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """(number, kind, parts): points, lines and polygons of .shp files, or of those in ZIP archives; parts are arrays of [x, y]."""

    def read(content: bytes) -> Iterator[tuple[int, str, list]]:
        at, n = 100, 0
        while at + 12 <= len(content):
            size = struct.unpack(">i", content[at + 4 : at + 8])[0] * 2
            body = content[at + 8 : at + 8 + size]
            kind = struct.unpack("<i", body[:4])[0] % 10
            if kind == 1:
                yield n, "Point", [[list(struct.unpack("<2d", body[4:20]))]]
            elif kind in (3, 5):
                parts, points = struct.unpack("<2i", body[36:44])
                begin = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
                flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
                pairs = [list(p) for p in zip(flat[::2], flat[1::2])]
                yield n, "LineString" if kind == 3 else "Polygon", [pairs[a:b] for a, b in zip(begin, begin[1:])]
            elif kind == 8:
                points = struct.unpack("<i", body[36:40])[0]
                flat = struct.unpack(f"<{2 * points}d", body[40 : 40 + 16 * points])
                yield n, "MultiPoint", [[list(p) for p in zip(flat[::2], flat[1::2])]]
            at, n = at + 8 + size, n + 1

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in map(bytes, batch["content"]):
                inner = [content]
                if content[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        inner = [z.read(m) for m in z.namelist() if m.lower().endswith(".shp")]
                for one in inner:
                    yield pd.DataFrame(list(read(one)), columns=["number", "kind", "parts"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(files, "number long, kind string, parts array<array<array<double>>>")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def yaml_table(spark: SparkSession, path: str) -> DataFrame:
    """(section, code, label) of a YAML file of mappings of mappings; a small file of settings, read on the driver."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows = [(str(s), str(k), str(v)) for s, m in (yaml.safe_load(text) or {}).items() if isinstance(m, dict) for k, v in m.items()]
    return spark.createDataFrame(rows, "section string, code string, label string")


def scraped_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, cells): the rows of the tables of pages as arrays of plain text."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all(F.col("tr"), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    plain = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")))
    return pages.select(key, F.posexplode(rows).alias("row", "tr")).select(key, "row", plain.alias("cells"))


def popup_degrees(text: Column) -> Column:
    """Decimal degrees of '41° 53' 24" N' or '12.5 E'."""
    parts = lambda i: F.regexp_extract(text, r"(-?[0-9.]+)\s*°?\s*(?:([0-9.]+)\s*['′])?\s*(?:([0-9.]+)\s*[\"″])?\s*([NSEWnsew])", i)
    value = parts(1).try_cast("double") + F.coalesce(parts(2).try_cast("double"), F.lit(0.0)) / 60 + F.coalesce(parts(3).try_cast("double"), F.lit(0.0)) / 3600
    return F.when(F.upper(parts(4)).isin("S", "W"), -value).otherwise(value)


# Fixed value: a span of years as the vocabulary of periods writes it.
PERIOD_SPAN = r"\(\s*(AD\s*)?([0-9]+)\s*(BC)?\s*-\s*(AD\s*)?([0-9]+)\s*(BC)?\s*\)"


def period_bounds(text: Column) -> Column:
    """struct(start, stop): the least and the greatest signed year of the last '(330 BC - AD 300)' in a text; null without one."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(PERIOD_SPAN), F.lit(0)), F.lit(-1))
    part = lambda i: F.regexp_extract(last, PERIOD_SPAN, i)
    year = lambda n, bc: F.when(part(bc) != "", -part(n).try_cast("int")).otherwise(part(n).try_cast("int"))
    both = F.array(year(2, 3), year(5, 6))
    return F.struct(F.array_min(both).alias("start"), F.array_max(both).alias("stop"))


def periods(spark: SparkSession, path: str, keyword: str, low: int = -900, high: int = 400) -> DataFrame:
    """(uri, label, start, stop): periods of a vocabulary (JSON with a map `periods`) whose coverage has a keyword, with whole years in a window."""
    schema = "periods map<string,struct<label:string,start:string,stop:string,coverage:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("periods").alias("uri", "p"))
    start, stop = F.col("p.start").try_cast("int"), F.col("p.stop").try_cast("int")
    out = rows.filter(F.lower("p.coverage").contains(keyword.lower())).select("uri", F.col("p.label").alias("label"), start.alias("start"), stop.alias("stop"))
    return out.filter(F.col("start").between(low, high) & F.col("stop").between(low, high) & (F.col("start") <= F.col("stop"))).orderBy("start", "stop", "label")
