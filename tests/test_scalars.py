"""Scalar functions on hand-made values, and the Unicode functions."""

import math

from pyspark.sql import functions as F

from aeonframe.functions import scalars as S, unicode as U


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_bins(spark):
    years = {-401: -425, -400: -400, -376: -400, -375: -375, -26: -50, -25: -25, -1: -25, 1: 1, 25: 1, 26: 26}
    rows = [(y,) for y in years]
    assert one(spark, rows, "y int", S.bin_edge(F.col("y"))) == list(years.values())
    assert one(spark, [(0,)], "y int", S.bin_edge(F.col("y"))) == [-24]
    both = spark.createDataFrame([(y,) for y in range(-900, 300) if y], "y int").select(S.bin_ordinal(S.bin_edge(F.col("y"))).alias("a"), S.year_ordinal(F.col("y")).alias("b"), S.bin_edge(F.col("y")).alias("e"), S.ordinal_edge(S.year_ordinal(F.col("y"))).alias("f"))
    assert all(r.a == r.b and r.e == r.f for r in both.collect())


def test_labels(spark):
    assert one(spark, [(-400,), (1,), (26,)], "e int", S.bin_label(F.col("e"))) == ["400–376 BC", "AD 1–25", "AD 26–50"]
    assert one(spark, [(-5,), (7,), (None,)], "y int", S.year_label(F.col("y"))) == ["5 BC", "AD 7", "undated"]


def test_numbers(spark):
    rows = [("3.7",), ("2.5",), ("3.5",), (" 12 ",), ("abc",), ("",), ("1e3",), ("nan",), ("inf",), (None,)]
    assert one(spark, rows, "s string", S.whole(F.col("s"))) == [4, 2, 4, 12, None, None, 1000, None, None, None]


def test_text(spark):
    rows = [("N/A",), (" a  b ",), ("-",), ("x",), (None,), ("  ",)]
    assert one(spark, rows, "s string", S.text(F.col("s"))) == [None, "a b", None, "x", None, None]


def test_places(spark):
    flags = one(spark, [("Este (?)",), ("X [found & written]",), ("Y",)], "s string", S.place_flags(F.col("s")))
    assert [tuple(f) for f in flags] == [("Este", 1, 0), ("X", 0, 1), ("Y", 0, 0)]
    rows = [("Tomba François",), ("Necropoli di Y",), ("A, B",), ("Roma",)]
    assert one(spark, rows, "s string", S.place_level(F.col("s"))) == ["tomb", "necropolis", "locality", "site"]
    assert one(spark, [("Città di Castèllo!",), ("??",)], "s string", S.slug(F.col("s"))) == ["citta-di-castello", "unnamed"]
    assert one(spark, [("Roma / Urbs (Rome)",)], "s string", S.name_variants(F.col("s"))) == [["roma", "roma-urbs-rome", "rome", "urbs", "urbs-rome"]]
    assert one(spark, [("Sepolcro 3",), ("cimitero di X",), ("A - B",)], "s string", S.place_level(F.col("s"))) == ["tomb", "necropolis", "locality"]
    assert [tuple(f) for f in one(spark, [("Roma?",), ("a (?) b",)], "s string", S.place_flags(F.col("s")))] == [("Roma", 1, 0), ("a (?) b", 0, 0)]
    assert one(spark, [("Ḥatra ß",), ("ﬁn Ⅷ ½",)], "s string", S.slug(F.col("s"))) == ["hatra", "fin-viii-12"]
    assert "ateste-este" in one(spark, [("Ateste (Este)",)], "s string", S.name_variants(F.col("s")))[0]


def test_labels_are_the_golden_ones(spark):
    edges = [e if e < 0 else e + 1 for e in range(-800, 125, 25)]
    want = [f"{-e}–{-e - 24} BC" if e < 0 else f"AD {e}–{e + 24}" for e in edges]
    assert want[0] == "800–776 BC" and want[-1] == "AD 101–125" and len(want) == 37
    assert one(spark, [(e,) for e in edges] + [(None,)], "e int", S.bin_label(F.col("e"))) == [*want, "undated"]


def test_geography(spark):
    rows = [(41.0, 12.0, 41.0, 12.0), (41.0, 12.0, 42.0, 12.0)]
    km = one(spark, rows, "a double, b double, c double, d double", S.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    assert km[0] == 0 and abs(km[1] - 111.195) < 1e-3


def test_entropy_and_normal(spark):
    bits = one(spark, [(0.5,), (0.0,), (1.0,)], "p double", S.entropy_bits(F.col("p")))
    assert bits[0] == 1 and abs(bits[1]) < 1e-9 and abs(bits[2]) < 1e-9
    xs = [-3.0, -1.0, 0.0, 0.5, 2.0]
    for x, p in zip(xs, one(spark, [(x,) for x in xs], "x double", S.normal_cdf(F.col("x")))):
        assert abs(p - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 1e-7


def test_properties(spark):
    df = spark.createDataFrame([({"Name": " ", "TITLE": "Roma"},), ({"name": "x"},), ({},)], "p map<string,string>")
    assert [r[0] for r in df.select(S.first_property(F.col("p"), "name", "title")).collect()] == ["Roma", "x", None]


def test_unicode(spark):
    rows = [("Città (x) di  Castèllo",), (None,)]
    assert one(spark, rows, "s string", U.fold(F.col("s"))) == ["citta di castello", None]
    damaged = "Vé".encode().decode("latin-1")
    twice = "è".encode().decode("latin-1").encode().decode("latin-1")
    assert one(spark, [(damaged,), (twice,), ("plain",), ("è",), (None,)], "s string", U.repair(F.col("s"))) == ["Vé", "è", "plain", "è", None]
    assert one(spark, [("roma", "roma"), ("roma", "romana"), ("a", "b"), (None, "b")], "a string, b string", U.similarity(F.col("a"), F.col("b"))) == [1.0, 0.9, 0.0, 0.0]
    df = spark.createDataFrame([("é",), ("é",), (None,)], "s string")
    assert sorted(map(str, (r.f for r in U.over_distinct(df, "s", U.fold, "f").collect()))) == ["None", "e", "e"]
