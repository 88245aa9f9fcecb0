"""Intervals, facets, search, hierarchies, geometry and models on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeonframe.operators import facets, geometry as G, hierarchy, intervals as I, models as M, search, spatial


def records(spark):
    rows = [(1, -400, -1, "a"), (2, 26, -50, "a"), (3, None, -10, "b"), (4, None, None, "b"), (5, -10, 9_000_000, None)]
    return I.with_ordinals(spark.createDataFrame(rows, "pk int, date_start int, date_end int, lang string"))


def test_expansion(spark):
    r = {x.pk: x for x in records(spark).collect()}
    assert (r[1].n_bins, r[2].n_bins, r[3].n_bins, r[4].n_bins, r[5].n_bins) == (16, 4, 1, None, 400)
    w = {x.pk: x for x in I.expand(records(spark)).groupBy("pk").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect()}
    assert all(abs(x.s - 1) < 1e-9 for x in w.values()) and set(w) == {1, 2, 3, 5}
    clamped = I.expand(records(spark), -4, -1).groupBy("pk").agg(F.sum("w").alias("s")).collect()
    assert {x.pk: round(x.s, 6) for x in clamped}[1] == 0.25


def test_timeline(spark):
    t = {x.ord: x for x in I.timeline(records(spark).filter("pk <= 3"), low=-2, high=-1).collect()}
    assert t[-1].possible == 3 and abs(t[-1].expected - (1 / 16 + 1 / 4 + 1)) < 1e-9
    assert abs(t[-1].sd ** 2 - (1 / 16 * 15 / 16 + 1 / 4 * 3 / 4)) < 1e-9


def test_overlap(spark):
    df = spark.createDataFrame([(-37, -12), (5, 5)], "a int, b int")
    event = {(x.a, x.bin_start): round(x.weight, 9) for x in I.overlap_weights(df, "a", "b", "event").collect()}
    assert event == {(-37, -50): 0.48, (-37, -25): 0.52, (5, 0): 1.0}


def test_merged_runs(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 5, 9), ("x", 20, 30), ("x", 2, 3)], "k string, a int, b int")
    assert sorted(tuple(r) for r in I.merged_runs(df, "k", "a", "b").select("a", "b", "n_periods").collect()) == [(1, 9, 3), (20, 30, 1)]


def test_facets(spark):
    r = records(spark)
    assert facets.selected(r, facets.Request({"lang": None})).count() == 5
    assert facets.selected(r, facets.Request({"lang": []})).count() == 0
    assert {x.pk for x in facets.selected(r, facets.Request({"lang": ["a"]}, (-16, -3))).collect()} == {1}
    assert facets.Request({"lang": ["a"]}).toggled("lang", "b", ["a", "b"]).sets["lang"] is None
    assert facets.Request({"lang": None}).toggled("lang", "b", ["a", "b"]).sets["lang"] == ["a"]
    counts = {(x.facet, x.value): x.n for x in facets.facet_counts(r, facets.Request({"lang": ["a"]}), ["lang"]).collect()}
    assert counts == {("lang", "a"): 2, ("lang", "b"): 2}


def test_search(spark):
    df = spark.createDataFrame([(1, "The Città of Rome"), (2, "of the city"), (3, None)], "pk int, t string")
    ix = search.index(df, "pk", "t")
    ids = lambda d: {r.pk for r in d.collect()}
    assert ids(search.any_of(ix, "pk", "citta", "city")) == {1, 2}
    assert ids(search.all_of(ix, "pk", "the", "of")) == {1, 2}
    assert ids(search.phrase(ix, "pk", "of", "the")) == {2}
    assert ids(search.prefix(ix, "pk", "cit")) == {1, 2}
    twice = search.index(spark.createDataFrame([(1, "a b a c a a")], "pk int, t string"), "pk", "t")
    assert ids(search.phrase(twice, "pk", "a", "a")) == {1} and ids(search.phrase(twice, "pk", "c", "b")) == set()


def test_hierarchy(spark):
    df = spark.createDataFrame([(1, "x", 2), (1, "y", 2), (2, None, 1)], "p int, l string, n int")
    m = {r.p: r for r in hierarchy.language_maps(df, "p", "l").collect()}
    assert m[1].main == "x" and m[1].counts == {"x": 1, "y": 1} and m[2].main is None
    slugs = spark.createDataFrame([(1, "a", "r"), (2, "a", "r"), (3, "a", "r"), (4, "b", "r")], "k int, s string, g string")
    found = [r.unique for r in hierarchy.unique_slugs(slugs, "k", "s", "g").orderBy("k").collect()]
    assert found[0] == "a" and found[1] == "a-r" and found[2].startswith("a-r-") and found[3] == "b"


def test_polygons(spark):
    ring = [(0, 0, 0.0, 0.0), (0, 1, 4.0, 0.0), (0, 2, 4.0, 4.0), (0, 3, 0.0, 4.0), (1, 0, 1.0, 1.0), (1, 1, 3.0, 1.0), (1, 2, 3.0, 3.0), (1, 3, 1.0, 3.0)]
    sides = spatial.edges(spark.createDataFrame(ring, "ring int, i int, lon double, lat double"), "ring", "i", "lon", "lat")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 9.0, 9.0)], "k int, lon double, lat double")
    assert {r.k: r.inside for r in spatial.inside(points, sides, "k").collect()} == {1: True, 2: False, 3: False}
    assert len(spatial.tiles(0, 0, 3, 2, 2)) == 2


def test_radius_join_is_brute_force(spark):
    r = np.random.default_rng(0)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(r.uniform(36, 47, 60), r.uniform(7, 18, 60)))]
    b = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(r.uniform(36, 47, 60), r.uniform(7, 18, 60)))]
    found = spatial.within_radius(spark.createDataFrame(a, "k int, lat double, lon double"), spark.createDataFrame(b, "t int, lat2 double, lon2 double"), 80).select("k", "t").collect()

    def km(p, q):
        f = math.radians
        h = math.sin(f(q[0] - p[0]) / 2) ** 2 + math.cos(f(p[0])) * math.cos(f(q[0])) * math.sin(f(q[1] - p[1]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    assert sorted(map(tuple, found)) == sorted((i, j) for i, *p in a for j, *q in b if km(p, q) <= 80)


def test_geometry():
    assert G.thinned([[0, 0], [1, 0.01], [2, 0]], 0.1) == [[0, 0], [2, 0]]
    assert G.simplified({"type": "Polygon", "coordinates": [[[0, 0], [0, 1], [1, 1], [0, 0]], [[0, 0], [0, 0]]]}, 0)["coordinates"] == [[[0, 0], [0, 1], [1, 1], [0, 0]]]
    assert G.from_wkt("SRID=4326;POINT Z (1 2 3)") == {"type": "Point", "coordinates": [1.0, 2.0]}
    assert G.from_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5 5, 5 5, 5 5)))")["coordinates"][1][0][1] == [6.0, 5.0]
    assert G.from_wkt("POLYGON EMPTY") is None and G.from_wkt("rubbish (x)") is None and G.from_wkt(None) is None
    way = {"type": "way", "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}]}
    assert G.of_osm_element(way)["type"] == "Polygon"
    assert G.bounding_box({"type": "MultiPoint", "coordinates": [[1, 2], [3, -1]]}) == (1, -1, 3, 2)


def test_logit_is_numpy(spark):
    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(400), r.normal(size=400)])
    y = (r.random(400) < 1 / (1 + np.exp(-x @ [0.3, 1.2]))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(t), 1.0) for (a, b), t in zip(x, y)], "one double, x double, y double, w double")
    penalty = np.diag([0.0, 0.5])
    beta, loglik, _ = M.fit_binary(df, ["one", "x"], "y", "w", penalty)
    b = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
    assert np.allclose(beta, b, atol=1e-6) and loglik < 0
    probit, _, _ = M.fit_binary(df, ["one", "x"], "y", "w", penalty, link="probit")
    assert np.allclose(probit * 1.7, b, atol=0.35)


def test_em_raises_the_likelihood(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(150):
        true = r.integers(0, 6)
        y = float(r.random() < 1 / (1 + math.exp(-(true - 2.5))))
        span = [t for t in range(6) if abs(t - true) <= 1]
        rows += [(i, 1.0, float(t), y, 1 / len(span)) for t in span]
    df = spark.createDataFrame(rows, "pk int, one double, t double, y double, w double")
    beta, loglik = M.em_latent_bin(df, "pk", ["one", "t"], "y", "w", np.diag([0.0, 0.01]), rounds=4)
    assert beta[1] > 0.4 and all(b >= a - 1e-6 for a, b in zip(loglik, loglik[1:]))


def test_bootstrap_covers(spark):
    r = np.random.default_rng(3)
    cells = [(i, float(r.binomial(20, 0.4)), 20.0) for i in range(100)]
    row = M.cluster_bootstrap(spark.createDataFrame(cells, "c int, y double, n double"), "c", ["y", "n"], [], lambda y, n: y / n).collect()[0]
    assert row.low < row.estimate < row.high and row.high - row.low < 0.1 and abs(row.estimate - 0.4) < 0.05


def test_folds_are_balanced(spark):
    rows = spark.createDataFrame([(i % 37,) for i in range(500)], "place int")
    sizes = [r["count"] for r in M.balanced_folds(rows, "place", 5).groupBy("fold").count().collect()]
    assert sum(sizes) == 37 and max(sizes) - min(sizes) <= 1


def test_numeric_functions():
    exact = 0.25 + math.asin(0.5) / (2 * math.pi)
    assert abs(M.bivariate_normal_cdf(0, 0, 0.5) - exact) < 1e-9
    assert abs(M.owens_t(0, 1) - 0.125) < 1e-9
    basis = M.sine_basis(np.linspace(-1, 1, 2001), 1.0, 0.0, 3)
    assert np.allclose(basis.T @ basis * 0.001, np.eye(3), atol=1e-3)
    line = np.arange(6.0)
    assert abs(line @ M.second_difference_penalty(6) @ line) < 1e-12


def test_few_is_checked(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "k int, x double, y double")
    t = spark.createDataFrame([(0.0, 1.0), (2.0, 0.0)], "x2 double, y2 double")
    assert spatial.nearest_of_few(p, t, "k").collect()[0].km == 1.0
    with pytest.raises(ValueError):
        spatial.nearest_of_few(p, t, "k", most=1)


def test_components_follow_chains(spark):
    from aeonframe.operators import hierarchy

    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 6), (9, 9)], "u long, v long")
    assert {tuple(r) for r in hierarchy.components(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 6)}
    assert hierarchy.components(pairs.filter("u > 99")).count() == 0


def test_wkt_grammar_and_closed_members():
    from aeonframe.operators import geometry as G

    assert G.from_wkt("MULTIPOINT ((1 2), (3 4.5e0))") == G.from_wkt("multipoint(1 2,3 4.5)") == {"type": "MultiPoint", "coordinates": [[1.0, 2.0], [3.0, 4.5]]}
    for broken in ("POINT (1)", "POINT (1 2", "POINT (1 2) x", "POINT ((1 2))", "POLYGON (1 2, 3 4)", "LINESTRING (1 2,)", "LINESTRING EMPTY", "", "SRID=4326"):
        assert G.from_wkt(broken) is None, broken
    way = lambda *p: {"geometry": [{"lon": x, "lat": y} for x, y in p]}
    ring = way((0, 0), (1, 0), (1, 1), (0, 0))
    assert G.of_osm_element({"type": "relation", "members": [ring, way((0, 0), (1, 0))]}) == {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}
    assert G.of_osm_element({"type": "relation", "members": [way((0, 0), (1, 0))]}) is None


def test_bootstrap_weights_follow_the_cluster(spark):
    import numpy as np
    from aeonframe.operators import models as M

    cells = spark.createDataFrame([(c, "ab"[c % 2], float(c % 3 == 0), 1.0) for c in range(400)] + [(0, None, 1.0, 2.0)], "c int, k string, y double, n double")
    rows = {r.k: r for r in M.cluster_bootstrap(cells.repartition(3), "c", ["y", "n"], ["k"], lambda y, n: y / n).collect()}
    again = {r.k: r for r in M.cluster_bootstrap(cells.coalesce(1), "c", ["y", "n"], ["k"], lambda y, n: y / n).collect()}
    assert all(np.allclose(rows[k][1:], again[k][1:]) for k in "ab") and rows[None].estimate == again[None].estimate == 0.5
    for k in "ab":
        assert abs(rows[k].estimate - 1 / 3) < 0.02 and rows[k].low < rows[k].estimate < rows[k].high
        assert abs(rows[k].se - np.sqrt(2 / 9 / 200)) < 0.01


def test_merged_runs_of_equal_periods(spark):
    # Which of two equal periods comes first is open; a new run must begin with the first one all the same.
    rows = [(k, a, a + w) for k in range(300) for a, w in ((0, 5), (0, 5), (10, 5), (10, 5), (10, 5), (15, 1), (30, 2), (30, 2))]
    found = I.merged_runs(spark.createDataFrame(rows, "k int, a int, b int").repartition(7), "k", "a", "b").collect()
    assert sorted(tuple(r) for r in found) == sorted((k, *run) for k in range(300) for run in ((0, 5, 2), (10, 16, 4), (30, 32, 2)))
