"""Queries of validation, models, geometry, grids, the console and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from aeonframe.functions import scalars as S, unicode as U
from aeonframe.operators import geometry, hierarchy, intervals, models, spatial
from aeonframe.sources import readers, writers

from .atlas import _VARIANTS
from .console import console
from .model import EXPANDED, PLACES, RECORDS, dated, places, records, table
from .registry import query

_SCORED = "scored AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, 1 / (1 + exp(-((o_totalprice / 1000) % 7 - 3))) AS p0, o_custkey FROM orders), s AS (SELECT *, round(p0, 3) AS p FROM scored)"


def _scored(spark, folder):
    o = table(spark, folder, "orders")
    p = S.logistic((F.col("o_totalprice") / 1000) % 7 - 3)
    return o.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), F.round(p, 3).alias("p"))


@query("AGG_26_binary_metrics", f"""WITH {_SCORED},
r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r, sum(y) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS tp, count(*) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS seen,
      greatest(least(p, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS q FROM s),
a AS (SELECT count(*) AS n, sum(y)::DOUBLE AS pos, sum(CASE WHEN y = 1 THEN r END) AS ranks, sum(CASE WHEN y = 1 THEN tp / seen END) AS ap, count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp,
      avg(power(p - y, 2)) AS brier, avg(-(y * log2(q) + (1 - y) * log2(1 - q))) AS loss FROM r)
SELECT n, round((ranks - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS auc, round(ap / pos, 6) AS average_precision, round(2 * tp / (tp + fp + pos), 6) AS f1, round((tp / pos + (n - pos - fp) / (n - pos)) / 2, 6) AS balanced_accuracy, round(brier, 6) AS brier, round(loss, 6) AS log_loss_bits FROM a""")
def binary_metrics(spark, folder):
    m = models.binary_metrics(_scored(spark, folder), "y", "p")
    return m.select("n", *(F.round(c, 6).alias(c) for c in m.columns[1:]))


@query("AGG_27_variance_shares", "WITH x AS (SELECT l_quantity::DOUBLE AS a, l_extendedprice / 1000 AS b, l_discount * 100 AS c FROM lineitem), s AS (SELECT a + b + c AS t, * FROM x) SELECT round(covar_pop(a, t) / var_pop(t), 6) AS share_a, round(covar_pop(b, t) / var_pop(t), 6) AS share_b, round(covar_pop(c, t) / var_pop(t), 6) AS share_c FROM s")
def variance_shares(spark, folder):
    """Each part's covariance with the sum over the sum's variance; the shares add up to 1."""
    x = table(spark, folder, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_discount") * 100).alias("c"))
    x = x.withColumn("t", F.col("a") + F.col("b") + F.col("c"))
    return x.agg(*(F.round(F.covar_pop(c, "t") / F.var_pop("t"), 6).alias(f"share_{c}") for c in "abc"))


@query("AGG_25_morans_i", f"""WITH {PLACES}, v AS (SELECT place_id AS key, lat, lon, value AS v, 1.0::DOUBLE AS weight FROM places),
m AS (SELECT sum(v * weight) / sum(weight) AS mean FROM v), z AS (SELECT key, lat, lon, weight, v - mean AS z FROM v, m),
p AS (SELECT a.z AS za, b.z AS zb, 2 * 6371 * asin(least(1, sqrt(power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) AS km FROM z a JOIN z b ON a.key <> b.key),
w AS (SELECT *, exp(-power(km / 40, 2)) AS w FROM p)
SELECT round((SELECT sum(w * za * zb) / sum(w) FROM w) / (SELECT sum(weight * z * z) / sum(weight) FROM z), 6) AS i, (SELECT count(*) FROM z) AS n""")
def morans_i(spark, folder):
    v = places(spark, folder).select(F.col("place_id").alias("key"), "lat", "lon", F.col("value").alias("v"), F.lit(1.0).alias("weight"))
    return spatial.morans_i(v, 40).select(F.round("i", 6).alias("i"), "n")


@query("STA_01_cluster_bootstrap")
def cluster_bootstrap(spark, folder):
    c = dated(spark, folder).groupBy("place_id", "language").agg(F.sum((F.col("script") == "O").cast("double")).alias("y"), F.count("*").cast("double").alias("n"))
    return models.cluster_bootstrap(c, "place_id", ["y", "n"], ["language"], lambda y, n: y / n)


@query("STA_02_blocked_folds")
def blocked_folds(spark, folder):
    return models.balanced_folds(records(spark, folder), "place_id", 10)


def _design(spark, folder):
    r = dated(spark, folder).filter("ord_start is not null")
    return r.select("pk", "place_id", F.lit(1.0).alias("one"), (F.col("ord_start") / 20.0).alias("time"), F.log1p("value").alias("size"), (F.col("script") == "O").cast("double").alias("y"), F.lit(1.0).alias("w"), "ord_start", "ord_end", "n_bins")


def _coefficients(spark, names, beta, covariance):
    return spark.createDataFrame([(n, float(b), float(np.sqrt(v))) for n, b, v in zip(names, beta, np.diag(covariance))], "term string, estimate double, se double")


@query("STA_03_penalised_logit")
def penalised_logit(spark, folder):
    names = ["one", "time", "size"]
    beta, _, cov = models.fit_binary(_design(spark, folder), names, "y", "w", np.diag([0.0, 0.1, 0.1]))
    return _coefficients(spark, names, beta, cov)


@query("STA_12_penalised_probit")
def penalised_probit(spark, folder):
    names = ["one", "time"]
    beta, _, cov = models.fit_binary(_design(spark, folder), names, "y", "w", np.diag([0.0, 0.1]), link="probit", rounds=8)
    return _coefficients(spark, names, beta, cov)


@query("STA_04_em_latent_bin")
def em_latent_bin(spark, folder):
    rows = intervals.expand(_design(spark, folder).withColumnRenamed("w", "one2")).withColumn("when", F.col("ord") / 20.0)
    names = ["one", "when"]
    beta, loglik = models.em_latent_bin(rows, "pk", names, "y", "w", np.diag([0.0, 0.1]), rounds=4)
    return spark.createDataFrame([(n, float(b), len(loglik)) for n, b in zip(names, beta)], "term string, estimate double, rounds long")


@query("STA_10_hilbert_basis")
def hilbert_basis(spark, folder):
    r = dated(spark, folder).filter("ord_start is not null").select("pk", "ord_start")
    return models.hilbert_basis(r, "ord_start", -16.0, 30.0, 6.0, 5)


@query("STA_20_standardised", "SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 6) AS z FROM supplier")
def standardised(spark, folder):
    s = table(spark, folder, "supplier")
    m = s.agg(F.avg("s_acctbal").alias("mean"), F.stddev_pop("s_acctbal").alias("sd"))
    return s.crossJoin(F.broadcast(m)).select("s_suppkey", F.round((F.col("s_acctbal") - F.col("mean")) / F.col("sd"), 6).alias("z"))  # one row


@query("STA_05_design_rows", f"""WITH {EXPANDED} SELECT pk, ord::BIGINT AS ord, list_sort(['lang=' || language, 'bin=' || ord, 'place=' || place_id]) AS terms FROM expanded""")
def design_rows(spark, folder):
    """Sparse design: the terms of each record and bin."""
    rows = intervals.expand(dated(spark, folder))
    return rows.select("pk", "ord", F.array_sort(F.array(F.concat(F.lit("lang="), "language"), F.concat(F.lit("bin="), F.col("ord").cast("string")), F.concat(F.lit("place="), F.col("place_id").cast("string")))).alias("terms"))


@query("MTH_03_binary_entropy", "WITH p AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') / count(*) AS p FROM orders GROUP BY 1), q AS (SELECT o_orderpriority, greatest(least(p, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS q FROM p) SELECT o_orderpriority, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) AS bits FROM q")
def binary_entropy(spark, folder):
    p = table(spark, folder, "orders").groupBy("o_orderpriority").agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("p"))
    return p.select("o_orderpriority", F.round(S.entropy_bits(F.col("p")), 6).alias("bits"))


@query("MTH_05_normal_cdf")
def normal_cdf(spark, folder):
    s = table(spark, folder, "supplier")
    return s.select("s_suppkey", F.round(S.normal_cdf(F.col("s_acctbal") / 5000 - 1), 6).alias("p"))


@query("MTH_06_colours")
def colours(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", S.hue_color(F.col("n_nationkey")).alias("colour"))


@query("MTH_08_kernel_weights", f"""WITH {PLACES}, k AS (SELECT DISTINCT CAST(floor(lat) * 1000 + floor(lon) AS BIGINT) AS knot, floor(lat) + 0.5 AS lat, floor(lon) + 0.5 AS lon FROM places),
d AS (SELECT p.place_id, k.knot, exp(-power(sqrt(power(p.lat - k.lat, 2) + power(p.lon - k.lon, 2)) / 0.8, 2) / 2) AS w FROM places p, k),
t AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY round(w, 9) DESC, knot) AS n FROM d)
SELECT place_id, knot, round(w / sum(w) OVER (PARTITION BY place_id), 6) AS w FROM t WHERE n <= 4""")
def kernel_weights(spark, folder):
    """The four nearest knots and their shares of a Gaussian kernel. Knots are the middles of the degrees with places: at most 64,800 on a globe, so they go along as one array."""
    p = places(spark, folder).select("place_id", "lat", "lon")
    south, west = F.floor("lat"), F.floor("lon")
    knots = p.select((south * 1000 + west).alias("knot"), (south + 0.5).alias("y"), (west + 0.5).alias("x")).distinct().agg(F.collect_list(F.struct("knot", "y", "x")).alias("knots"))
    near = lambda k: F.exp(-(F.pow(F.col("lat") - k["y"], 2) + F.pow(F.col("lon") - k["x"], 2)) / (2 * 0.8**2))
    weighed = F.transform("knots", lambda k: F.struct((-F.round(near(k), 9)).alias("o"), k["knot"].alias("knot"), near(k).alias("w")))
    top = p.crossJoin(F.broadcast(knots)).select("place_id", F.slice(F.array_sort(weighed), 1, 4).alias("b"))  # one row
    total = F.aggregate("b", F.lit(0.0), lambda s, x: s + x["w"])
    return top.select("place_id", F.explode("b").alias("k"), total.alias("total")).select("place_id", F.col("k.knot").alias("knot"), F.round(F.col("k.w") / F.col("total"), 6).alias("w"))


@query("DAT_05_mid_years", "SELECT o::BIGINT AS o, -787.5::DOUBLE + 25 * o AS mid_year FROM (SELECT unnest(generate_series(0, 36)) AS o)")
def mid_years(spark, folder):
    return spark.range(37).select(F.col("id").alias("o"), S.bin_mid_year(F.col("id")).alias("mid_year"))


@query("FLT_10_support_mask", f"""WITH {RECORDS}, {PLACES}, j AS (SELECT r.language, lat BETWEEN 38 AND 44 AS inside, r.value FROM records r JOIN places USING (place_id))
SELECT language, count(*) FILTER (inside) AS kept, count(*) FILTER (NOT inside) AS lost, round(sum(value) FILTER (NOT inside), 2) AS lost_value FROM j GROUP BY language""")
def support_mask(spark, folder):
    """Evidence within its source's support, and how much is lost outside."""
    j = records(spark, folder).join(places(spark, folder).select("place_id", F.col("lat").between(38, 44).alias("inside")), "place_id")
    out = ~F.col("inside")
    return j.groupBy("language").agg(F.count_if(F.col("inside")).alias("kept"), F.count_if(out).alias("lost"), F.round(F.sum(F.when(out, F.col("value"))), 2).alias("lost_value"))


@query("FLT_02_empty_rows", "SELECT count(*) FILTER (a IS NOT NULL OR b IS NOT NULL) AS kept, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS b FROM customer)")
def empty_rows(spark, folder):
    k = F.col("c_custkey")
    c = table(spark, folder, "customer").select(F.when(k % 3 != 0, F.col("c_name")).alias("a"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("b"))
    return c.dropna(how="all").agg(F.count("*").alias("kept")).crossJoin(F.broadcast(c.agg(F.count("*").alias("n"))))  # one row each


@query("FLT_15_catalogue_selection", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'europe' OR n_nationkey IN (1, 2)")
def catalogue_selection(spark, folder):
    n = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.filter((F.lower("r_name") == "europe") | F.col("n_nationkey").isin(1, 2)).select("n_name")


@query("FLT_17_label_subset", "SELECT p_partkey FROM part WHERE contains(p_type, 'M') AND NOT contains(p_type, 'SMALL')")
def label_subset(spark, folder):
    return table(spark, folder, "part").filter(F.col("p_type").contains("M") & ~F.col("p_type").contains("SMALL")).select("p_partkey")


@query("FLT_18_boxed_names", f"WITH {PLACES} SELECT place_id, trim(unnest(string_split(lower(name), '#'))) AS name FROM places WHERE lat BETWEEN 40 AND 42 AND lon BETWEEN 10 AND 14")
def boxed_names(spark, folder):
    p = places(spark, folder).filter(F.col("lat").between(40, 42) & F.col("lon").between(10, 14))
    return p.select("place_id", F.explode(F.transform(F.split(F.lower("name"), "#"), lambda x: F.trim(x))).alias("name"))


@query("JON_17_cells_and_bins", "WITH c AS (SELECT r_regionkey FROM region), b AS (SELECT unnest(generate_series(0, 6)) AS bin), n AS (SELECT n_regionkey, n_nationkey % 7 AS bin, count(*) AS n FROM nation GROUP BY ALL) SELECT r_regionkey::BIGINT AS r_regionkey, b.bin::BIGINT AS bin, coalesce(n, 0) AS n FROM c CROSS JOIN b LEFT JOIN n ON n_regionkey = r_regionkey AND n.bin = b.bin")
def cells_and_bins(spark, folder):
    """Every cell in every bin, zero where nothing is; bins are made by a sequence in each cell."""
    cells = table(spark, folder, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("bin"))
    n = table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey"), (F.col("n_nationkey") % 7).alias("bin")).agg(F.count("*").alias("n"))
    return cells.join(n, ["r_regionkey", "bin"], "left").select("r_regionkey", "bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("JON_07_composite_keys", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem JOIN (SELECT l_orderkey AS a, min(l_linenumber) AS b FROM lineitem GROUP BY 1) ON l_orderkey = a AND l_linenumber = b GROUP BY ALL")
def composite_keys(spark, folder):
    l = table(spark, folder, "lineitem")
    first = l.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    return l.join(first, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("JON_12_signed_distance")
def signed_distance(spark, folder):
    """Kilometres to the corners of a frontier, negative inside."""
    ring = [(8.0, 37.0), (17.0, 38.0), (15.0, 45.0), (11.0, 41.0), (8.5, 45.5)]
    p = places(spark, folder).select("place_id", "lat", "lon", S.plane_x(F.col("lon")).alias("x"), S.plane_y(F.col("lat")).alias("y"))
    corners = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(ring)], "ring int, i int, lon double, lat double")
    d = spatial.nearest_of_few(p, corners.select(S.plane_x(F.col("lon")).alias("x2"), S.plane_y(F.col("lat")).alias("y2")), "place_id")
    i = spatial.inside(p, spatial.edges(corners, "ring", "i", "lon", "lat"), "place_id")
    return d.join(i, "place_id").select("place_id", F.round(F.when(F.col("inside"), -F.col("km")).otherwise(F.col("km")), 6).alias("km"))


_MERGED = "'Locus' || place_id % 23 || CASE WHEN place_id % 2 = 0 THEN ' / Locus' || place_id * 5 % 23 WHEN place_id % 5 = 0 THEN ' (Locus' || place_id % 11 || ')' ELSE '' END"


@query("SET_04_place_merge", f"""WITH RECURSIVE {PLACES}, n AS (SELECT place_id, floor(lat) AS a, floor(lon) AS b, {_MERGED} AS name FROM places),
v AS (SELECT place_id, a, b, unnest({_VARIANTS.replace("NAME", "name")}) AS v FROM n),
e AS (SELECT DISTINCT x.place_id AS u, y.place_id AS w FROM v x JOIN v y USING (a, b, v) WHERE x.place_id <> y.place_id),
reach AS (SELECT u, w FROM e UNION SELECT r.u, e.w FROM reach r JOIN e ON r.w = e.u),
c AS (SELECT place_id, any_value(name) AS name, least(place_id, coalesce(min(w), place_id)) AS component FROM n LEFT JOIN reach ON u = place_id GROUP BY place_id),
k AS (SELECT *, first_value(name) OVER o AS kept, row_number() OVER o AS r FROM c WINDOW o AS (PARTITION BY component ORDER BY length(name) DESC, place_id))
SELECT component, min(place_id) FILTER (r = 1) AS place_id, any_value(kept) AS name, coalesce(list_sort(list(DISTINCT name) FILTER (name <> kept)), []) AS aliases, count(*) AS n_places FROM k GROUP BY component""")
def place_merge(spark, folder):
    """Places of one spot that share a name variant, directly or through others; the longest name is kept, the others are aliases."""
    p = places(spark, folder).selectExpr("place_id", "concat_ws(',', floor(lat), floor(lon)) AS spot", f"{_MERGED} AS name")
    pairs = hierarchy.merge_names(p.withColumn("variants", S.name_variants(F.col("name"))), "place_id", "spot", "variants")
    found = hierarchy.components(pairs)
    p = p.join(found, p["place_id"] == found["node"], "left").withColumn("component", F.coalesce("component", "place_id"))
    return hierarchy.keepers(p, "component", "name", "place_id").select("component", "place_id", "name", "aliases", "n_places")


@query("SNK_12_grid_payload", f"""WITH {EXPANDED}, c AS (SELECT language, ord, sum(w) AS v FROM expanded WHERE ord BETWEEN -3 AND -1 GROUP BY ALL)
SELECT language, CAST(coalesce(round_even(sum(v) FILTER (ord = -3) * 100, 0), 0) AS BIGINT) AS "-3", CAST(coalesce(round_even(sum(v) FILTER (ord = -2) * 100, 0), 0) AS BIGINT) AS "-2", CAST(coalesce(round_even(sum(v) FILTER (ord = -1) * 100, 0), 0) AS BIGINT) AS "-1" FROM c GROUP BY language""")
def grid_payload(spark, folder):
    c = intervals.expand(dated(spark, folder)).filter("ord between -3 and -1").groupBy("language", "ord").agg(F.sum("w").alias("v"))
    return writers.grid_payload(c, "language", "ord", "v", [-3, -2, -1])


@query("SNK_03_column_major")
def column_major(spark, folder):
    return writers.column_major(table(spark, folder, "nation"), ["n_nationkey"], ["n_name"])


@query("SNK_04_features")
def feature_rows(spark, folder):
    return writers.features(places(spark, folder), "lon", "lat", ["place_id"])


@query("GEO_01_simplified_lines")
def simplified_lines(spark, folder):
    """Each region's places as a line, simplified."""
    p = places(spark, folder)
    line = F.transform(F.array_sort(F.collect_list(F.struct("place_id", "lon", "lat"))), lambda s: F.array(s["lon"], s["lat"]))
    g = p.groupBy("region").agg(F.to_json(F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))).alias("g"))
    return g.select("region", geometry.simplify_json(F.col("g"), 0.5).alias("geometry"))


@query("GEO_03_wkt")
def wkt(spark, folder):
    p = places(spark, folder)
    return p.select("place_id", geometry.wkt_to_json(F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))).alias("geometry"))


@query("STR_01_text_repair")
def text_repair(spark, folder):
    """Documents whose UTF-8 was read as Latin-1, put right."""
    d = table(spark, folder, "documents").select("doc_id", F.col("text"))
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return d.select("doc_id", (U.repair(damaged) == F.col("text")).alias("restored"))


@query("STR_10_folded_names")
def folded_names(spark, folder):
    n = table(spark, folder, "nation").withColumn("title", F.concat(F.lit("Città "), "n_name", F.lit(" (IT)")))
    return U.over_distinct(n, "title", U.fold, "folded").select("n_nationkey", "folded")


@query("STR_12_similarity")
def name_similarity(spark, folder):
    n = table(spark, folder, "nation").select("n_nationkey", "n_regionkey", "n_name")
    other = n.select(F.col("n_nationkey").alias("other"), F.col("n_regionkey").alias("r2"), F.col("n_name").alias("name2"))
    pairs = n.join(other, (F.col("n_regionkey") == F.col("r2")) & (F.col("n_nationkey") < F.col("other")))
    return pairs.select("n_nationkey", "other", F.round(U.similarity(F.lower("n_name"), F.lower("name2")), 6).alias("score"))


_PERIOD_TEXTS = ["Republic (330 BC - AD 300)", "640 BC to 30 BC", "(200 - 100 BC)", "late (500 BC - 400 BC), again ( AD 1 - AD 300 )", "no years", "(30 BC - 640 BC)", "(1-25)"]
_SPAN = r"\(\s*(AD\s*)?([0-9]+)\s*(BC)?\s*-\s*(AD\s*)?([0-9]+)\s*(BC)?\s*\)"


@query("SRC_22_period_bounds", rf"""WITH t AS (SELECT unnest([{", ".join(f"'{x}'" for x in _PERIOD_TEXTS)}]) AS t), l AS (SELECT t, regexp_extract_all(t, '{_SPAN}')[-1] AS s FROM t),
y AS (SELECT t, CAST(regexp_extract(s, '{_SPAN}', 2) AS BIGINT) * CASE WHEN regexp_extract(s, '{_SPAN}', 3) = '' THEN 1 ELSE -1 END AS a, CAST(regexp_extract(s, '{_SPAN}', 5) AS BIGINT) * CASE WHEN regexp_extract(s, '{_SPAN}', 6) = '' THEN 1 ELSE -1 END AS b FROM l)
SELECT t, least(a, b) AS start, greatest(a, b) AS stop FROM y""")
def period_bounds(spark, folder):
    rows = spark.createDataFrame([(x,) for x in _PERIOD_TEXTS], "t string")
    return rows.select("t", readers.period_bounds(F.col("t")).alias("b")).select("t", "b.start", "b.stop")


_CONSOLE = {
    "CON_Q1_per_language": ("SELECT language, count(*) AS n FROM records GROUP BY language ORDER BY n DESC, language", None),
    "CON_Q2_richest_places": ("SELECT name, count(*) AS n FROM records JOIN places USING (place_id) GROUP BY name ORDER BY n DESC, name LIMIT 20", None),
    "CON_Q4_cross_having": ("SELECT language, region, count(*) AS n FROM records JOIN places USING (place_id) GROUP BY language, region HAVING n > 20", "SELECT language, region::BIGINT AS region, count(*) AS n FROM records JOIN places USING (place_id) GROUP BY language, region HAVING n > 20"),
    "CON_Q5_many_languages": ("SELECT place_id, count(DISTINCT language) AS n FROM records GROUP BY place_id HAVING n > 3", None),
    "CON_Q7_earliest": ("SELECT region, min(date_start) AS first FROM records JOIN places USING (place_id) GROUP BY region", "SELECT region::BIGINT AS region, min(date_start)::BIGINT AS first FROM records JOIN places USING (place_id) GROUP BY region"),
    "CON_windows_and_sets": (
        "WITH r AS (SELECT place_id, pk, row_number() OVER (PARTITION BY place_id ORDER BY value DESC, pk) AS n FROM records), top AS (SELECT place_id FROM r WHERE n = 5) SELECT place_id FROM top EXCEPT SELECT place_id FROM records WHERE value > 400000",
        None,
    ),
    "CON_rollup": ("SELECT language, script, count(*) AS n FROM records GROUP BY ROLLUP (language, script)", None),
    "CON_recursive": ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS s FROM t", None),
}


def _console_query(text):
    def run(spark, folder):
        return console(spark, {"records": records(spark, folder), "places": places(spark, folder)}, text, None)

    return run


for _name, (_text, _other) in _CONSOLE.items():
    _recursive = (_other or _text).startswith("WITH")
    _sql = _other or _text
    if _sql.startswith("WITH RECURSIVE"):
        _oracle = _sql
    elif _sql.startswith("WITH "):
        _oracle = f"WITH {RECORDS}, {PLACES}, {_sql[5:]}"
    else:
        _oracle = f"WITH {RECORDS}, {PLACES} {_sql}"
    query(_name, _oracle)(_console_query(_text))


@query("STREAM_windowed_counts", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, folder):
    """The batch form of the streamed counts: the same operator on a table at rest."""
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("day"), "n")
