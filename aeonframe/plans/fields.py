"""Queries of fields and categories over space and time, without oracles: they rest on iterative fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from aeonframe.functions import scalars as S
from aeonframe.operators import fields, geometry, intervals, models

from .model import PLACES, dated, places, records, table
from .registry import query

_BOX = (7.0, 36.0, 18.0, 46.0)


def _cells(spark, folder):
    """Expected records by half-degree cell and bin, on a lattice with zeros."""
    r = intervals.expand(dated(spark, folder)).join(places(spark, folder).select("place_id", "lat", "lon"), "place_id").filter("ord between -24 and -1")
    across = round((_BOX[2] - _BOX[0]) / 1.0)
    cell = (F.floor(F.col("lat") - _BOX[1]) * across + F.floor(F.col("lon") - _BOX[0])).cast("long")
    n = r.groupBy(cell.alias("cell"), F.col("ord").alias("bin")).agg(F.sum("w").alias("n"))
    grid = fields.lattice(_BOX, 1.0, list(range(-24, 0, 4)), spark)
    return grid.join(n, ["cell", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0.0))).withColumn("e", F.lit(1.0))


def _basis():
    return fields.FieldBasis((12.5, 41.0, -12.0), (8.0, 8.0, 18.0), (3.0, 8.0), (3, 3, 2))


@query("STA_16_count_field")
def count_field(spark, folder):
    """A log-linear field of expected records on a basis over space and time: mean and sd on the lattice."""
    basis, grid = _basis(), _cells(spark, folder)
    made = fields.with_basis(grid, basis, "lon", "lat", "bin").withColumn("one", F.lit(1.0))
    names = ["one", *basis.names()]
    beta, covariance, _ = fields.fit_counts(made, names, "n", "e", np.diag([0.0] + [1.0] * len(basis.names())), rounds=6)
    return fields.predicted(grid.select("cell", "bin", "lon", "lat"), basis, "lon", "lat", "bin", beta[1:], covariance[1:, 1:]).select("cell", "bin", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"))


@query("STA_14_multinomial")
def multinomial(spark, folder):
    codes = {"F": 0, "O": 1, "P": 2}
    r = dated(spark, folder).filter("ord_start is not null").select(F.lit(1.0).alias("one"), (F.col("ord_start") / 20.0).alias("time"), F.lit(1.0).alias("w"), sum((F.when(F.col("script") == k, v).otherwise(0) for k, v in codes.items()), F.lit(0)).alias("y"))
    beta, _ = fields.fit_classes(r, ["one", "time"], "y", "w", 3, 0.1, rounds=8)
    return spark.createDataFrame([(k, t, float(beta[v, i])) for k, v in codes.items() for i, t in enumerate(("one", "time"))], "class string, term string, estimate double")


@query("STA_13_pair_correlation")
def pair_correlation(spark, folder):
    r = records(spark, folder).select((F.col("script") == "O").cast("int").alias("a"), (F.col("language") < "3").cast("int").alias("b"), F.lit(0.0).alias("ea"), F.lit(-0.25).alias("eb"))
    return spark.createDataFrame([(round(fields.pair_correlation(r, ("a", "ea"), ("b", "eb")), 3),)], "rho double")


@query("STA_19_reliabilities")
def source_reliabilities(spark, folder):
    c = intervals.expand(dated(spark, folder)).groupBy("script", "ord").agg(F.sum("w").alias("o"))
    mean = c.groupBy("script").agg(F.avg("o").alias("e"))
    return fields.reliabilities(c.join(mean, "script"), "script", "o", "e")


@query("STA_06_model_ladder")
def model_ladder(spark, folder):
    """Two models on held-out folds of places: the overall rate, and the rate by language."""
    r = records(spark, folder).select(F.col("place_id").alias("place"), "language", (F.col("script") == "O").cast("double").alias("y"), models.fold_of("place_id", 3).alias("fold"))

    def overall(train, test):
        return test.crossJoin(F.broadcast(train.agg(F.avg("y").alias("p")))).select("place", "y", "p")  # one row

    def by_language(train, test):
        rate = train.groupBy("language").agg(((F.sum("y") + 1) / (F.count("*") + 2)).alias("p"))
        return test.join(rate, "language").select("place", "y", "p")

    return fields.model_ladder(r, {"overall": overall, "by language": by_language}, "fold", 3, "place")


@query("GEO_02_simplified_polygons")
def simplified_polygons(spark, folder):
    """A box around each region's places as a polygon, simplified and closed."""
    b = places(spark, folder).groupBy("region").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    corner = lambda x, y: F.array(x, y)
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))
    g = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    return b.select("region", geometry.simplify_json(g, 0.01).alias("geometry"), geometry.box_json(g).alias("box"))


@query("GEO_04_elements")
def elements(spark, folder):
    p = places(spark, folder)
    e = F.to_json(F.struct(F.lit("node").alias("type"), "lat", "lon"))
    return p.select("place_id", geometry.element_to_json(e).alias("geometry"))


@query("GEO_06_ring_vertices", f"WITH {PLACES}, v AS (SELECT region, lon, lat, row_number() OVER (PARTITION BY region ORDER BY place_id) AS n FROM places) SELECT region::BIGINT AS region, n, lon, lat FROM v")
def ring_vertices(spark, folder):
    line = F.array_sort(F.collect_list(F.struct("place_id", "lon", "lat")))
    rings = places(spark, folder).groupBy("region").agg(line.alias("ring"))
    return rings.select("region", F.posexplode("ring").alias("n", "v")).select("region", (F.col("n") + 1).cast("long").alias("n"), "v.lon", "v.lat")


@query("GEO_07_support_masks", f"WITH {PLACES} SELECT place_id, CASE WHEN lon BETWEEN 9 AND 16 AND abs(lat - 41) * 111 <= 50 THEN 'coast' WHEN lon BETWEEN 9 AND 16 THEN 'land' WHEN abs(lat - 41) * 111 <= 50 THEN 'near sea' ELSE 'far sea' END AS support FROM places")
def support_masks(spark, folder):
    c = places(spark, folder).select("place_id", F.col("lon").between(9, 16).alias("inside"), (F.abs(F.col("lat") - 41) * 111).alias("coast_km"))
    return fields.support_classes(c).select("place_id", "support")


@query("AGG_45_national_trajectory")
def national_trajectory(spark, folder):
    """The mean of a field over its cells, by bin."""
    return count_field(spark, folder).groupBy("bin").agg(F.round(F.avg("mean"), 4).alias("mean"), F.count("*").alias("cells"))


@query("STA_11_recovery")
def recovery(spark, folder):
    """Known chances by bin, outcomes drawn from them by a hash, and how near the expansion's rates come, by bin."""
    d = dated(spark, folder).filter("ord_start is not null")
    true = S.logistic((F.col("ord_start") + 16) / 8.0)
    draw = (F.shiftrightunsigned(F.xxhash64("pk", F.lit("recovery")), 11).cast("double") + 0.5) / float(1 << 53)
    rows = intervals.expand(d.withColumn("y", (draw < true).cast("double")))
    est = rows.groupBy("ord").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("estimate"), F.sum("w").alias("mass"))
    return est.filter("mass >= 5").select("ord", F.round("estimate", 6).alias("estimate"), F.round(S.logistic((F.col("ord") + 16) / 8.0), 6).alias("truth"))


@query("SRT_05_shown_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2000")
def shown_rows(spark, folder):
    from .console import console

    return console(spark, {"orders": table(spark, folder, "orders")}, "SELECT 1; SELECT o_orderkey FROM orders ORDER BY o_orderkey")
