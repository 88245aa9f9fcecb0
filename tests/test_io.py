"""Readers, writers, the console and streams on files made here."""

import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from aeonframe.plans.console import console, statements
from aeonframe.sources import readers as R, writers as W
from aeonframe.streaming import timeline as T


def test_delimited(spark, tmp_path):
    body = "ID,Name,Extra\n1,Vé,x\n2, N/A \n3,\"two\nlines\",y,z\n,,\n".encode()
    body = body.replace("Vé".encode(), "Vé".encode()) + "4,Forl\xec,q\n".encode("latin-1")
    (tmp_path / "a.csv").write_bytes(body)
    rows, warnings = R.delimited(spark, str(tmp_path / "a.csv"), {"ID": "id", "Name": "name", "Gone": "gone"})
    assert sorted(warnings) == ["missing column Gone", "unknown column Extra"]
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("1", "Vé", None), ("2", None, None), ("3", "two lines", None), ("4", "Forlì", None)]
    audit = R.encoding_audit(spark.createDataFrame([("VÃ©",), ("ok",), ("VÃ©",)], "s string")).collect()
    assert [(r.column, r.n) for r in audit] == [("s", 2)]


def test_layers(spark, tmp_path):
    layer = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"Name": "in", "rank": 2}, "geometry": {"type": "Point", "coordinates": [12.5, 41.9]}},
        {"type": "Feature", "properties": {"other": "x"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
        {"type": "Feature", "properties": {"name": "polygon"}, "geometry": {"type": "Polygon", "coordinates": [[[10, 40], [14, 40], [14, 44], [10, 40]]]}},
    ]}
    (tmp_path / "l.geojson").write_text(json.dumps(layer))
    rows = R.geojson(spark, [str(tmp_path / "l.geojson")], (11, 41, 13, 43), need_name=True, rank_field="rank").collect()
    assert sorted((r.name, r.rank) for r in rows) == [("in", 2.0), ("polygon", None)]
    (tmp_path / "n.ndjson").write_text('{"a": 1}\nrubbish\n{"a": 2}\n')
    assert sorted(r.a for r in R.ndjson(spark, str(tmp_path / "n.ndjson"), "a long").collect() if r.a) == [1, 2]


def test_archives_and_shapes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("data/places.csv", "id,wkt\n1,POINT (1 2)\n2,\n")
        z.writestr("data/names.csv", "id\n9\n")
    rows = R.zipped_tables(spark, str(tmp_path / "g.zip"), "places").collect()
    assert {(r.row, r.column, r.value) for r in rows} == {(0, "id", "1"), (0, "wkt", "POINT (1 2)"), (1, "id", "2"), (1, "wkt", "")}
    point = struct.pack("<i2d", 1, 3.0, 4.0)
    line = struct.pack("<i4d2i", 3, 0, 0, 1, 1, 1, 2) + struct.pack("<i", 0) + struct.pack("<4d", 0, 0, 1, 1)
    body = b"\0" * 100 + b"".join(struct.pack(">2i", n + 1, len(x) // 2) + x for n, x in enumerate((point, line)))
    (tmp_path / "s.shp").write_bytes(body)
    found = R.shapes(spark, str(tmp_path / "s.shp")).orderBy("number").collect()
    assert [(r.kind, r.parts) for r in found] == [("Point", [[[3.0, 4.0]]]), ("LineString", [[[0.0, 0.0], [1.0, 1.0]]])]


def test_markup(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<all><row><id>1</id></row><row><id>2</id></row></all>")
    assert sorted(r.id for r in R.xml_rows(spark, str(tmp_path / "x.xml"), "row").collect()) == [1, 2]
    pages = spark.createDataFrame([(1, "<table><tr><th>A</th><td>b <i>c</i></td></tr><tr></tr></table>"), (2, None)], "k int, h string")
    assert [(r.row, r.cells) for r in R.scraped_rows(pages, "k", "h").collect()] == [(0, ["A", "b c"]), (1, [])]
    df = spark.createDataFrame([("41° 30' 36\" N",), ("12.5 W",), ("none",)], "t string")
    assert [r[0] for r in df.select(R.popup_degrees(F.col("t"))).collect()] == [41.51, -12.5, None]
    texts = spark.createDataFrame([("(330 BC - AD 300)",), ("640 BC to 30 BC",), ("(200 - 100 BC)",), ("a (5 BC - AD 9), b (30 BC - 640 BC)",), ("no",)], "t string")
    bounds = [tuple(r[0]) for r in texts.select(R.period_bounds(F.col("t"))).collect()]
    assert bounds == [(-330, 300), (None, None), (-100, 200), (-640, -30), (None, None)]
    (tmp_path / "p.json").write_text(json.dumps({"periods": {"u1": {"label": "A", "start": "-500", "stop": "-300", "coverage": "Italy"}, "u2": {"label": "B", "start": "x", "stop": "1", "coverage": "Italy"}, "u3": {"label": "C", "start": "-5", "stop": "1", "coverage": "Gaul"}}}))
    assert [r.uri for r in R.periods(spark, str(tmp_path / "p.json"), "italy").collect()] == ["u1"]


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yml").write_text("use:\n  1: votive\n  2: funerary\nnote: x\n")
    assert {tuple(r) for r in R.yaml_table(spark, str(tmp_path / "c.yml")).collect()} == {("use", "1", "votive"), ("use", "2", "funerary")}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 1.0), (1, "a", None), (3, "b", 3.0)], "k int, v string, x double")
    W.star({"t": df}, str(tmp_path))
    W.views(spark, str(tmp_path), ["t"])
    assert spark.sql("SELECT count(*) FROM t").first()[0] == 3
    assert "k INT" in W.ddl("t", df)
    payload = json.loads(W.column_major(df, ["k"], ["v"]).first().json)
    assert payload["n"] == 3 and payload["columns"]["k"] == [1, 2, 3] and payload["columns"]["v"] == [1, 2, 2] and payload["dicts"]["v"] == ["", "a", "b"]
    feature = json.loads(W.features(df.withColumn("y", F.col("x")), "x", "y", ["k"]).first().json)
    assert feature["geometry"]["coordinates"] == [1.0, 1.0] and feature["properties"]["k"] == 2
    W.csv_table(spark.createDataFrame([('say "x", y',)], "s string"), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().s == 'say "x", y'
    digest = W.fingerprint({"t": df})
    assert digest == W.fingerprint({"t": df.orderBy("v")}) != W.fingerprint({"t": df.limit(2)})
    assert W.is_stale(spark, str(tmp_path / "stamp"), digest)
    W.stamp(spark, str(tmp_path / "stamp"), digest)
    assert not W.is_stale(spark, str(tmp_path / "stamp"), digest)


def test_console(spark):
    t = {"t": spark.range(5).toDF("a")}
    assert console(spark, t, "SELECT 1; -- x; y\nSELECT sum(a) AS s FROM t WHERE 'a;b' <> ''").first().s == 10
    assert console(spark, t, "SELECT * FROM t", shown=2).count() == 2
    assert statements("a; 'x;y' ; /* ; */ b") == ["a", "'x;y'", "/* ; */ b"]
    spark.sql("CREATE TABLE IF NOT EXISTS console_target (a BIGINT) USING parquet")
    writes = ["WITH x AS (SELECT 1 AS a) INSERT INTO console_target SELECT a FROM x", "FROM t INSERT INTO console_target SELECT a", "CREATE TABLE other AS SELECT 1", "/* SELECT */ DROP TABLE t", "CACHE TABLE t", "REFRESH TABLE t"]
    for bad in ("DROP TABLE t", "SELECT 1; INSERT INTO t VALUES (1)", "SET x = 1", *writes):
        with pytest.raises(ValueError):
            console(spark, t, bad)
    assert spark.table("console_target").count() == 0
    spark.sql("DROP TABLE console_target")
    for good in ("EXPLAIN SELECT a FROM t", "DESCRIBE t", "WITH x AS (SELECT a FROM t WHERE a IN (SELECT 1)) SELECT * FROM x -- end\n;", "FROM t SELECT a", "SHOW TABLES", "(SELECT 1) UNION ALL (VALUES (2))"):
        assert console(spark, t, good).count() >= 1, good


def test_streams(spark, tmp_path):
    schema = "ts timestamp, kind string, date_start int, date_end int"
    for n, rows in enumerate([[("2024-01-01 00:10:00", "a", -50, -1), ("2024-01-01 05:00:00", "a", 1, 25)], [("2024-01-01 00:20:00", "a", -25, -1), ("2024-01-01 09:00:00", "b", None, None)]]):
        spark.createDataFrame(rows, "t string, kind string, date_start int, date_end int").select(F.to_timestamp("t").alias("ts"), "kind", "date_start", "date_end").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={n}"))
    source = T.events(spark, str(tmp_path / "in" / "*"), schema)
    T.run_once(T.windowed(source, "ts", ["kind"]), "counts", str(tmp_path / "c1"), "update")
    assert spark.table("counts").count() >= 3
    T.run_once(T.running_timeline(source, "kind"), "timeline", str(tmp_path / "c2"), "complete")
    assert {(r.kind, r.ord): r.expected for r in spark.table("timeline").collect()} == {("a", -2): 0.5, ("a", -1): 1.5, ("a", 0): 1.0}
