"""Distances, nearest neighbours, points in polygons and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeonframe.functions import scalars as S
from aeonframe.operators.quantiles import values_at

#: Cells of a degree's share, for joins within a radius.
CELL_DEGREES = 0.25
#: Targets of a cube at most, where closest() starts.
CROWD = 64


def cell(c: Column, size: float = CELL_DEGREES) -> Column:
    return F.floor(c / size).cast("long")


def within_radius(left: DataFrame, right: DataFrame, km: float, size: float = CELL_DEGREES) -> DataFrame:
    """Pairs of rows of left (lat, lon) and right (lat2, lon2) at most km apart, with km.

    Rows meet by cells of a grid: the left side goes to all cells within reach,
    the right side to its own, so it is an equi-join and no cross join.
    """
    reach = int(km / (111.0 * size)) + 1
    # A degree of longitude is shorter: as far north as 60 degrees it is half.
    wide = 2 * reach
    around = F.explode(F.sequence(cell(F.col("lat"), size) - reach, cell(F.col("lat"), size) + reach)).alias("_cy")
    a = left.select("*", around).select("*", F.explode(F.sequence(cell(F.col("lon"), size) - wide, cell(F.col("lon"), size) + wide)).alias("_cx"))
    b = right.withColumns({"_by": cell(F.col("lat2"), size), "_bx": cell(F.col("lon2"), size)})
    pairs = a.join(b, (a["_cy"] == b["_by"]) & (a["_cx"] == b["_bx"])).drop("_cy", "_cx", "_by", "_bx")
    return pairs.withColumn("km", S.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).filter(F.col("km") <= km)


def _on_sphere(lat: str, lon: str) -> list[Column]:
    y, x = F.radians(lat), F.radians(lon)
    return [(S.EARTH_KM * c).alias(n) for c, n in ((F.cos(y) * F.cos(x), "x"), (F.cos(y) * F.sin(x), "y"), (F.sin(y), "z"))]


def closest(points: DataFrame, targets: DataFrame, km: float, rank: Column | None = None) -> DataFrame:
    """(lat, lon, best): for each different place of points (lat, lon) with targets (lat2, lon2) within km, the least `rank` of these.

    rank is the distance km if not given, and else orders by it first, rounded
    to six places at most. Targets should be of different places, and the
    smaller side. Places meet in cubes around the globe: as a chord is no
    longer than its arc, a hit within a cube's width in the cubes around is
    proven nearest. Places without one go on with cubes twice as wide, at last
    as wide as km, so pairs grow with the places and not with their product,
    unless most points have all their targets in a dense spot some way off.
    """
    rank = F.col("km") if rank is None else rank
    real = ~F.isnan(F.col("x") + F.col("y") + F.col("z"))  # null coordinates make it null
    todo = points.select("lat", "lon").distinct().select("lat", "lon", *_on_sphere("lat", "lon")).filter(real).persist()
    there = targets.select("*", *_on_sphere("lat2", "lon2")).filter(real).persist()
    box = there.agg(F.count("*"), *(F.max(c) - F.min(c) for c in "xyz")).first()
    reach = km + 1e-3
    width = min(reach, max(2 * max(box[1:]) / box[0] ** 0.5, reach / 1024)) if box[0] else reach
    cubes = lambda: [cell(F.col(c), width).alias("c" + c) for c in "xyz"]
    # Dense spots ask for narrower cubes than the mean does.
    while width > reach / 2**16 and (there.groupBy(*cubes()).count().agg(F.max("count")).first()[0] or 0) > CROWD:
        width /= 2
    within = F.col("lat2").isNotNull() & (F.col("km") <= km)
    found = None
    while True:
        last = width >= reach
        around = there.select(*targets.columns, *cubes())
        for c in ("cx", "cy", "cz"):
            around = around.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        # A left join, as a plan that names the step before it twice would double with each step. No broadcast: these are 27 times the rows that Spark expects.
        pairs = todo.select("lat", "lon", *cubes()).join(around.hint("merge"), ["cx", "cy", "cz"], "left")
        pairs = pairs.withColumn("km", S.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
        step = pairs.groupBy("lat", "lon").agg(F.min(F.when(within, F.col("km"))).alias("_km"), F.min(F.when(within, rank)).alias("best")).persist()
        # The margin holds what rank rounds off.
        proven = F.coalesce(F.col("_km") <= (km if last else width - 1e-5), F.lit(False))
        hits = step.filter(proven).select("lat", "lon", "best")
        found = hits if found is None else found.unionByName(hits)
        if last:
            return found
        todo = step.filter(~proven).select("lat", "lon", *_on_sphere("lat", "lon"))
        if todo.isEmpty():
            return found
        width *= 2


def near(points: DataFrame, targets: DataFrame, km: float) -> DataFrame:
    """Points (lat, lon) with any target (lat2, lon2) within km."""
    return points.join(closest(points, targets.select("lat2", "lon2").distinct(), km), ["lat", "lon"], "left_semi").select(points.columns)


def nearest(points: DataFrame, targets: DataFrame, key: str, km: float) -> DataFrame:
    """(key, km): the least distance from each point to a target within km; points without one are left out."""
    found = closest(points, targets.select("lat2", "lon2").distinct(), km)
    return points.join(found, ["lat", "lon"]).groupBy(key).agg(F.min("best").alias("km"))


def best_within(points: DataFrame, targets: DataFrame, key: str, km: float) -> DataFrame:
    """(key, target, km): the nearest target (target, lat2, lon2) within km, by km to six places, the least of equally near ones."""
    least = targets.groupBy("lat2", "lon2").agg(F.min("target").alias("target"))
    found = closest(points, least, km, F.struct(F.round("km", 6).alias("km"), "target"))
    best = points.join(found, ["lat", "lon"]).groupBy(key).agg(F.min("best").alias("best"))
    return best.select(key, F.col("best.target").alias("target"), F.col("best.km").alias("km"))


def nearest_of_few(points: DataFrame, targets: DataFrame, key: str, most: int = 10_000, self_key: str | None = None) -> DataFrame:
    """(key, km): the least plane distance to any target (x2, y2); with self_key, to another one.

    For targets that are few: their number is counted, and more than `most`
    raise ValueError, for which nearest() is the way.
    """
    if targets.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} targets: use nearest() with a radius")
    pairs = points.join(F.broadcast(targets), F.col(key) != F.col(self_key) if self_key else F.lit(True))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    return pairs.groupBy(key).agg(F.min(d).alias("km"))


def nearest_other(points: DataFrame, key: str) -> DataFrame:
    """(key, km): the least plane distance from each point (key, x, y) to any other; a point alone is left out.

    Points meet in grid cells: a hit within a cell's width in the cells around
    is proven nearest. Those without one go on with cells twice as wide, until
    the cells around hold all points.
    """
    at = points.filter("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n")).persist()
    box = at.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    places = box[4]
    wide = max(box[1] - box[0], box[3] - box[2]) if places else 0.0
    width = wide / max(places, 1) ** 0.5
    found = at.filter("n > 1").select("x", "y", F.lit(0.0).alias("km"))
    todo = at.filter("n = 1").select("x", "y")
    while places > 1:
        last = width >= wide
        cx, cy = cell(F.col("x") - box[0], width), cell(F.col("y") - box[2], width)
        around = todo.select("x", "y", cx.alias("cx"), F.explode(F.sequence(cy - 1, cy + 1)).alias("cy"))
        around = around.select("x", "y", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy")
        other = at.select(F.col("x").alias("x2"), F.col("y").alias("y2"), cx.alias("cx"), cy.alias("cy"))
        pairs = around.join(other, ["cx", "cy"]).filter((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2")))
        d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
        hits = pairs.groupBy("x", "y").agg(F.min(d).alias("km"))
        hits = (hits if last else hits.filter(F.col("km") <= width)).persist()
        found = found.unionByName(hits)
        todo = todo.join(hits, ["x", "y"], "left_anti").persist()
        if last or todo.isEmpty():
            break
        width *= 2
    return points.join(found, ["x", "y"]).select(key, "km")


def edges(rings: DataFrame, ring: str, order: str, lon: str, lat: str) -> DataFrame:
    """(ring, x1, y1, x2, y2): the sides of closed rings of vertices."""
    by = Window.partitionBy(ring).orderBy(order)
    whole = Window.partitionBy(ring).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole))
    return rings.select(ring, F.col(lon).alias("x1"), F.col(lat).alias("y1"), following(lon).alias("x2"), following(lat).alias("y2"))


def inside(points: DataFrame, sides: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """(key, inside): even-odd rule over all rings, so a hole is outside.

    The sides of the polygons are few: they are counted, and more than `most`
    raise ValueError.
    """
    if sides.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} sides of polygons")
    y, x = F.col("lat"), F.col("lon")
    spans = (F.col("y1") > y) != (F.col("y2") > y)
    crosses = spans & (x < (F.col("x2") - F.col("x1")) * F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = points.join(F.broadcast(sides), spans).groupBy(key).agg((F.count_if(crosses) % 2 == 1).alias("_in"))
    return points.select(key).join(hits, key, "left").select(key, F.coalesce("_in", F.lit(False)).alias("inside"))


def tiles(west: float, south: float, east: float, north: float, step: float) -> list[tuple[float, float, float, float]]:
    """A box cut into tiles of `step` degrees, the last ones narrower."""
    out, y = [], south
    while y < north - 1e-9:
        x = west
        while x < east - 1e-9:
            out.append((x, y, min(x + step, east), min(y + step, north)))
            x += step
        y += step
    return out


def central_box(points: DataFrame, lon: str, lat: str, share: float = 0.005) -> DataFrame:
    """One row (west, south, east, north): the box without the outermost share on each side, by index and not interpolated."""
    found = {c: values_at(points, c, lambda n: [n * share + 1, n * (1 - share)]) for c in (lon, lat)}
    row = (found[lon][0], found[lat][0], found[lon][1], found[lat][1])
    return points.sparkSession.createDataFrame([row], "west double, south double, east double, north double")


def snapped(c: Column, size: float = 0.25) -> Column:
    """The nearest line of a grid, half to even."""
    return F.bround(c / size) * size


def morans_i(values: DataFrame, bandwidth_km: float, reach_km: float | None = None, size: float = 1.0) -> DataFrame:
    """One row (i, n): Moran's I of values (key, lat, lon, v, weight) under weights exp(-(d / bandwidth)^2) sqrt(weight weight2).

    Pairs beyond reach_km, six bandwidths if not given, are left out: each has
    a factor below exp(-36) = 2.4e-16. Values at one place on the map meet as
    sums, so pairs are of different places.
    """
    reach_km = 6 * bandwidth_km if reach_km is None else reach_km
    mean = values.agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("mean"))
    z = values.crossJoin(F.broadcast(mean)).withColumns({"z": F.col("v") - F.col("mean"), "root": F.sqrt("weight")})  # one row of means
    at = z.groupBy("lat", "lon").agg(F.sum(F.col("root") * F.col("z")).alias("a"), F.sum("root").alias("c"))
    other = at.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("a").alias("a2"), F.col("c").alias("c2"))
    w = F.exp(-F.pow(F.col("km") / bandwidth_km, 2))
    top = within_radius(at, other, reach_km, size).agg(F.sum(w * F.col("a") * F.col("a2")).alias("top"), F.sum(w * F.col("c") * F.col("c2")).alias("w"))
    # A value is no neighbour of its own.
    own = z.agg(F.sum(F.col("weight") * F.col("z") * F.col("z")).alias("own"), F.sum("weight").alias("total"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.count("*").alias("n"))
    return top.crossJoin(F.broadcast(own)).select((F.col("n") * (F.col("top") - F.col("own")) / (F.col("w") - F.col("total")) / F.col("zz")).alias("i"), "n")
