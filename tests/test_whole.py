"""Queries that take in all rows, against plain Python on the smallest tables."""

import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeonframe.catalog import QUERIES
from aeonframe.functions import scalars as S
from aeonframe.operators import spatial
from aeonframe.plans import model

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no small tables")


def test_design_rows_of_all_records(spark):
    dated = model.dated(spark, FOLDER).filter("ord_start is not null").select("pk", "ord_start", "ord_end", "language", "place_id").collect()
    wanted = sorted((r.pk, o, sorted([f"lang={r.language}", f"bin={o}", f"place={r.place_id}"])) for r in dated for o in range(r.ord_start, r.ord_end + 1))
    assert sorted((r.pk, r.ord, r.terms) for r in QUERIES["STA_05_design_rows"](spark, FOLDER).collect()) == wanted


def brute_morans_i(rows, bandwidth):
    lat, lon, v, weight = np.array(rows, float).T
    y, x = np.radians(lat), np.radians(lon)
    h = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y)[:, None] * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
    w = np.exp(-((2 * 6371 * np.arcsin(np.sqrt(h)) / bandwidth) ** 2))
    np.fill_diagonal(w, 0)
    w *= np.sqrt(np.outer(weight, weight))
    z = v - np.average(v, weights=weight)
    return len(v) / w.sum() * (w * np.outer(z, z)).sum() / (z**2).sum()


def test_morans_i_of_all_places(spark):
    rows = [(r.lat, r.lon, r.value, 1) for r in model.places(spark, FOLDER).collect()]
    found = QUERIES["AGG_25_morans_i"](spark, FOLDER).collect()[0]
    assert found.n == len(rows) and abs(found.i - brute_morans_i(rows, 40)) < 2e-6
    r = np.random.default_rng(2)
    # Shared places on the map and unequal weights.
    rows = [(float(41 + r.integers(6) / 4), float(12 + r.integers(6) / 4), float(r.normal()), float(r.integers(1, 9))) for _ in range(90)]
    values = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "key int, lat double, lon double, v double, weight double")
    assert abs(spatial.morans_i(values, 40).collect()[0].i - brute_morans_i(rows, 40)) < 1e-9


def test_encoding_audit_of_whole_texts(spark, tmp_path):
    head = "a" * 200
    rows = [("s", head + "é one"), ("s", head + "é two"), ("s", head + "é two"), ("s", head)]
    spark.createDataFrame(rows, "source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["STR_03_encoding_audit"](spark, str(tmp_path)).collect()
    assert [(r.column, r.value, r.n) for r in found] == [("text", head + "Ã© two", 2), ("text", head + "Ã© one", 1)]


def brute_nearest_other(rows):
    return {k: min(float(np.hypot(x - a, y - b)) for j, a, b in rows if j != k) for k, x, y in rows}


def test_nearest_of_all_other_places(spark):
    p = model.places(spark, FOLDER).select("place_id", S.plane_x(F.col("lon")), S.plane_y(F.col("lat")))
    wanted = brute_nearest_other([tuple(r) for r in p.collect()])
    found = {r.place_id: r.km for r in QUERIES["JON_10_nearest_other"](spark, FOLDER).collect()}
    assert set(found) == set(wanted) and all(abs(found[k] - wanted[k]) < 2e-6 for k in wanted)
    r = np.random.default_rng(3)
    # A dense spot, far single points, shared places.
    spots = [*r.normal(0, 0.01, (60, 2)).tolist(), *r.uniform(-900, 900, (20, 2)).tolist(), [5.0, 5.0], [5.0, 5.0], [90_000.0, -4e4]]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(spots)]
    wanted = brute_nearest_other(rows)
    found = {r.k: r.km for r in spatial.nearest_other(spark.createDataFrame(rows, "k int, x double, y double"), "k").collect()}
    assert set(found) == set(wanted) and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
    assert spatial.nearest_other(spark.createDataFrame(rows[:1], "k int, x double, y double"), "k").count() == 0


@pytest.fixture
def limited(spark):
    """Jobs that run on after two minutes are cancelled, which is an error."""
    timer = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


def one_spot(spark, tmp_path, *tables):
    """Tables of 300,000 rows at one place on the map, so 90 billion pairs."""
    for name, key in tables:
        spark.range(300_000).select((F.col("id") * 11_000).alias(key), *(F.lit(None).cast(t).alias(c) for c, t in (("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double")))).write.parquet(f"{tmp_path}/{name}.parquet")


def scattered(spark):
    """Points and targets: dense and far spots, copies, poles, both sides of the date line, places without coordinates."""
    r = np.random.default_rng(5)
    spots = np.concatenate([r.uniform((36, 7), (47, 18), (80, 2)), r.normal((42, 12), 0.05, (80, 2)), r.uniform((-90, -180), (90, 180), (40, 2)), [(89.9, 10), (89.9, -170), (0, 179.9), (0, -179.9), (-90, 0), (36.0, 7.0), (36.0, 7.0)]])
    a = [(i, float(y), float(x)) for i, (y, x) in enumerate(spots)]
    b = [(i, float(y), float(x)) for i, (y, x) in enumerate([*r.uniform((36, 7), (47, 18), (60, 2)), *r.normal((42, 12), 0.05, (60, 2)), (89.9, 100), (0, 180), (-89.9, 60), (36.0, 7.0), (36.0, 7.0), (36.3, 7.0)])]
    nulls = [(900, None, 1.0), (901, float("nan"), 1.0)]
    km = {}
    for i, *p in a:
        for j, *q in b:
            (y, x), (v, u) = np.radians(p), np.radians(q)
            km[i, j] = float(2 * 6371 * np.arcsin(min(1, np.sqrt(np.sin((v - y) / 2) ** 2 + np.cos(y) * np.cos(v) * np.sin((u - x) / 2) ** 2))))
    return spark.createDataFrame(a + nulls, "k int, lat double, lon double"), spark.createDataFrame(b + nulls, "target int, lat2 double, lon2 double"), km


@pytest.mark.parametrize("km", [0.5, 60, 900])
def test_near_is_brute_force(spark, limited, km):
    points, targets, all_km = scattered(spark)
    assert sorted(r.k for r in spatial.near(points, targets, km).collect()) == sorted({i for (i, _), d in all_km.items() if d <= km})
    assert spatial.near(points, targets.filter("target > 950"), km).count() == 0


def test_near_any_of_many_at_one_place(spark, limited, tmp_path):
    one_spot(spark, tmp_path, ("customer", "c_custkey"))
    assert QUERIES["FLT_12_near_any"](spark, str(tmp_path)).count() == 300_000


@pytest.mark.parametrize("km", [0.5, 60, 900])
def test_nearest_is_brute_force(spark, limited, km):
    points, targets, all_km = scattered(spark)
    wanted = {}
    for (i, _), d in all_km.items():
        if d <= km:
            wanted[i] = min(d, wanted.get(i, d))
    found = {r.k: r.km for r in spatial.nearest(points, targets, "k", km).collect()}
    assert set(found) == set(wanted) and all(abs(found[k] - wanted[k]) < 1e-6 for k in wanted)


def test_nearest_distance_of_many_at_one_place(spark, limited, tmp_path):
    one_spot(spark, tmp_path, ("customer", "c_custkey"), ("supplier", "s_suppkey"))
    found = QUERIES["JON_09_nearest_distance"](spark, str(tmp_path))
    assert found.agg(F.count("*"), F.min("km"), F.max("km")).first() == (300_000, 0, 0)


@pytest.mark.parametrize("km", [0.5, 60, 900])
def test_best_within_is_brute_force(spark, limited, km):
    points, targets, all_km = scattered(spark)
    wanted = {}
    for (i, j), d in all_km.items():
        if d <= km:
            wanted[i] = min((round(d, 6), j), wanted.get(i, (d + 1, j)))
    found = {r.k: (r.km, r.target) for r in spatial.best_within(points, targets, "k", km).collect()}
    assert set(found) == set(wanted) and all(abs(found[k][0] - wanted[k][0]) < 2e-6 and found[k][1] == wanted[k][1] for k in wanted)


def test_equally_near_targets_are_the_least(spark):
    points = spark.createDataFrame([(1, 42.0, 12.0), (2, 42.0, 12.0)], "k int, lat double, lon double")
    around = [(9, 42.1, 12.0), (8, 42.1 + 1e-9, 12.0), (5, 42.1, 12.0), (7, 42.1 + 1e-5, 12.0), (4, 43.0, 12.0), (3, 42.2, 12.0)]
    targets = spark.createDataFrame(around, "target int, lat2 double, lon2 double")
    assert sorted(tuple(r) for r in spatial.best_within(points, targets, "k", 30).collect()) == [(1, 5, 11.119493), (2, 5, 11.119493)]
    assert spatial.best_within(points, targets.filter("target <> 5"), "k", 30).first().target == 8


def test_best_within_radius_of_many_at_one_place(spark, limited, tmp_path):
    one_spot(spark, tmp_path, ("customer", "c_custkey"), ("supplier", "s_suppkey"))
    found = QUERIES["JON_08_best_within_radius"](spark, str(tmp_path))
    assert found.agg(F.count("*"), F.max("target"), F.max("km")).first() == (300_000, 0, 0)
