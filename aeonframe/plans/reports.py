"""Queries of counts, summaries, orders and sets that reports are made of."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from aeonframe.functions import scalars as S
from aeonframe.operators import entropy, hierarchy, intervals, spatial
from aeonframe.sources import readers

from .model import DATED, EXPANDED, PLACES, RECORDS, dated, places, records, table
from .registry import query


@query("AGG_05_place_spans", f"WITH {RECORDS} SELECT place_id, min(date_start)::BIGINT AS first, max(date_end)::BIGINT AS last, count(*) AS n FROM records GROUP BY 1")
def place_spans(spark, folder):
    return records(spark, folder).groupBy("place_id").agg(F.min("date_start").alias("first"), F.max("date_end").alias("last"), F.count("*").alias("n"))


@query("AGG_06_descendants", f"WITH {RECORDS}, {PLACES}, a AS (SELECT place_id, count(*) AS n FROM records GROUP BY 1) SELECT p.place_id, coalesce(sum(a.n), 0)::BIGINT AS n_descendants FROM places p LEFT JOIN places c ON c.parent_id = p.place_id LEFT JOIN a ON a.place_id = c.place_id WHERE p.parent_id IS NULL GROUP BY 1")
def descendants(spark, folder):
    a = records(spark, folder).groupBy("place_id").agg(F.count("*").alias("n"))
    p = places(spark, folder).select("place_id", "parent_id")
    up = p.filter("parent_id is not null").join(a, "place_id").groupBy(F.col("parent_id").alias("up")).agg(F.sum("n").alias("n"))
    return p.filter("parent_id is null").join(up, F.col("place_id") == F.col("up"), "left").select("place_id", F.coalesce("n", F.lit(0)).alias("n_descendants"))


@query("AGG_15_main_keys", f"WITH {RECORDS}, c AS (SELECT place_id, language, count(*) AS c FROM records GROUP BY ALL) SELECT place_id, arg_min(language, (-c, language)) AS main FROM c GROUP BY 1")
def main_keys(spark, folder):
    return hierarchy.language_maps(records(spark, folder), "place_id", "language").select("place_id", "main")


@query("AGG_19_entropy_split", f"""WITH {EXPANDED}, c AS (SELECT language, ord, sum(w) AS n, sum(CASE WHEN script = 'O' THEN w ELSE 0 END) AS y FROM expanded GROUP BY ALL HAVING sum(w) >= 20),
p AS (SELECT *, greatest(least(y / n, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS q FROM c)
SELECT language, round(sum(n), 6) AS mass, round(sum(n * -(q * log2(q) + (1 - q) * log2(1 - q))) / sum(n), 6) AS bits FROM p GROUP BY language""")
def entropy_split(spark, folder):
    rows = intervals.expand(dated(spark, folder)).withColumn("y", (F.col("script") == "O").cast("double"))
    c = entropy.cells(rows, ["language", "ord"], "y", "w").filter("mass >= 20")
    return c.groupBy("language").agg(F.round(F.sum("mass"), 6).alias("mass"), F.round(F.sum(F.col("mass") * S.entropy_bits(F.col("share"))) / F.sum("mass"), 6).alias("bits"))


@query("AGG_28_pooled_rates", f"WITH {EXPANDED} SELECT language, ord::BIGINT AS ord, round(sum(w * value) / sum(w), 4) AS pooled, round(sum(w), 6) AS mass FROM expanded GROUP BY ALL HAVING sum(w) >= 2")
def pooled_rates(spark, folder):
    rows = intervals.expand(dated(spark, folder)).groupBy("language", "ord").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("pooled"), F.sum("w").alias("mass"))
    return rows.filter("mass >= 2").select("language", "ord", F.round("pooled", 4).alias("pooled"), F.round("mass", 6).alias("mass"))


@query("AGG_37_leave_one_out", f"""WITH {EXPANDED}, a AS (SELECT ord, sum(w) AS v FROM expanded GROUP BY ord), s AS (SELECT script, ord, sum(w) AS v FROM expanded GROUP BY ALL),
d AS (SELECT k.script, a.ord, a.v, a.v - coalesce(s.v, 0) AS rest FROM a CROSS JOIN (SELECT DISTINCT script FROM s) k LEFT JOIN s ON s.script = k.script AND s.ord = a.ord)
SELECT script, round(avg(abs(v - rest)), 6) AS mean_change, round(max(abs(v - rest)), 6) AS max_change, round(corr(v, rest), 6) AS r FROM d GROUP BY script""")
def leave_one_out(spark, folder):
    """Influence of each source: the series without it against the whole."""
    s = intervals.expand(dated(spark, folder)).groupBy("ord").pivot("script", ["F", "O", "P"]).agg(F.sum("w")).na.fill(0.0)
    total = F.col("F") + F.col("O") + F.col("P")
    each = s.select("ord", total.alias("v"), F.explode(F.array(*(F.struct(F.lit(k).alias("script"), F.col(k).alias("own")) for k in "FOP"))).alias("s"))
    rest = F.col("v") - F.col("s.own")
    return each.groupBy("s.script").agg(F.round(F.avg(F.abs("s.own")), 6).alias("mean_change"), F.round(F.max(F.abs("s.own")), 6).alias("max_change"), F.round(F.corr(F.col("v"), rest), 6).alias("r"))


@query("AGG_38_composite_index", "WITH v AS (SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS s FROM customer GROUP BY ALL), l AS (SELECT c_nationkey, c_mktsegment, ln(1 + greatest(s, 0)) AS x FROM v), q AS (SELECT c_mktsegment, quantile_cont(x, 0.99) AS top FROM l GROUP BY 1), z AS (SELECT c_nationkey, greatest(least(x / top, 1), 0) AS z, c_mktsegment FROM l JOIN q USING (c_mktsegment)) SELECT c_nationkey::BIGINT AS c_nationkey, round(sum(CASE c_mktsegment WHEN 'BUILDING' THEN 0.45 WHEN 'MACHINERY' THEN 0.35 WHEN 'FURNITURE' THEN 0.2 ELSE 0 END * z), 6) AS index, round(avg(CASE WHEN z > 0.02 THEN 1.0 ELSE 0 END), 6) AS diversity FROM z GROUP BY 1")
def composite_index(spark, folder):
    """Components on a log scale over their 99 % point, weighted; diversity is the share of components that count."""
    v = table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.log1p(F.greatest(F.sum("c_acctbal"), F.lit(0.0))).alias("x"))
    top = v.groupBy("c_mktsegment").agg(F.percentile("x", 0.99).alias("top"))
    z = v.join(top, "c_mktsegment").withColumn("z", F.greatest(F.least(F.col("x") / F.col("top"), F.lit(1.0)), F.lit(0.0)))
    weight = F.when(F.col("c_mktsegment") == "BUILDING", 0.45).when(F.col("c_mktsegment") == "MACHINERY", 0.35).when(F.col("c_mktsegment") == "FURNITURE", 0.2).otherwise(0.0)
    return z.groupBy("c_nationkey").agg(F.round(F.sum(weight * F.col("z")), 6).alias("index"), F.round(F.avg(F.when(F.col("z") > 0.02, 1.0).otherwise(0.0)), 6).alias("diversity"))


@query("AGG_42_inside_outside", f"WITH {RECORDS}, {PLACES} SELECT language, lat > 41.5 AS north, count(*) AS n, round(avg(CASE WHEN script = 'O' THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM records JOIN places USING (place_id) GROUP BY ALL")
def inside_outside(spark, folder):
    r = records(spark, folder).join(places(spark, folder).select("place_id", "lat"), "place_id")
    return r.groupBy("language", (F.col("lat") > 41.5).alias("north")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("script") == "O").cast("double")), 6).alias("rate"))


@query("AGG_43_narrow_curves", f"""WITH {RECORDS}, d AS (SELECT language, script, CASE WHEN date_start < 0 THEN -((-date_start + 99) // 100) ELSE (date_start - 1) // 100 + 1 END AS century FROM records WHERE date_end - date_start <= 100),
c AS (SELECT language, century, count(*) AS n, avg(CASE WHEN script = 'O' THEN 1.0::DOUBLE ELSE 0 END) AS share FROM d GROUP BY ALL HAVING count(*) >= 15), q AS (SELECT *, greatest(least(share, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS q FROM c)
SELECT language, century::BIGINT AS century, n, round(share, 6) AS share, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) AS bits FROM q""")
def narrow_curves(spark, folder):
    d = records(spark, folder).filter("date_end - date_start <= 100").withColumn("century", S.century(F.col("date_start")))
    c = d.groupBy("language", "century").agg(F.count("*").alias("n"), F.avg((F.col("script") == "O").cast("double")).alias("share")).filter("n >= 15")
    return c.select("language", "century", "n", F.round("share", 6).alias("share"), F.round(S.entropy_bits(F.col("share")), 6).alias("bits"))


@query("AGG_46_payload_totals", "SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(octet_length(encode(text))) FILTER (lang = 'en')::BIGINT AS default_bytes FROM documents GROUP BY source")
def payload_totals(spark, folder):
    size = F.octet_length("text")
    return table(spark, folder, "documents").groupBy("source").agg(F.sum(size).cast("long").alias("bytes"), F.sum(F.when(F.col("lang") == "en", size)).cast("long").alias("default_bytes"))


@query("AGG_48_interval_table", "SELECT l_linenumber::BIGINT AS l_linenumber, round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 5) AS low, round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 5) AS high FROM lineitem GROUP BY 1")
def interval_table(spark, folder):
    half = 1.96 * F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))
    return table(spark, folder, "lineitem").groupBy("l_linenumber").agg(F.round(F.avg("l_quantity") - half, 5).alias("low"), F.round(F.avg("l_quantity") + half, 5).alias("high"))


@query("AGG_49_place_summaries", f"WITH {RECORDS}, c AS (SELECT place_id, language, count(*) AS c, min(date_start) AS a, max(date_end) AS b FROM records GROUP BY ALL) SELECT place_id, sum(c)::BIGINT AS n, string_agg(language, ', ' ORDER BY c DESC, language) AS languages, min(a)::BIGINT AS first, max(b)::BIGINT AS last FROM c GROUP BY 1")
def place_summaries(spark, folder):
    c = records(spark, folder).groupBy("place_id", "language").agg(F.count("*").alias("c"), F.min("date_start").alias("a"), F.max("date_end").alias("b"))
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "language"))), lambda s: s["language"])
    return c.groupBy("place_id").agg(F.sum("c").alias("n"), F.array_join(names, ", ").alias("languages"), F.min("a").alias("first"), F.max("b").alias("last"))


@query("MAP_01_count_maps", f"WITH {RECORDS}, c AS (SELECT script, language, count(*) AS c FROM records GROUP BY ALL) SELECT script, string_agg(language || ':' || c, ' ' ORDER BY language) AS counts FROM c GROUP BY 1")
def count_maps(spark, folder):
    m = hierarchy.language_maps(records(spark, folder), "script", "language")
    entries = F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return m.select("script", F.array_join(entries, " ").alias("counts"))


@query("EXP_12_group_codes", f"WITH {RECORDS}, k AS (SELECT DISTINCT language, script FROM records) SELECT language, script, row_number() OVER (ORDER BY language, script) - 1 AS code FROM k")
def group_codes(spark, folder):
    k = records(spark, folder).select("language", "script").distinct()
    return k.select("language", "script", (F.row_number().over(Window.orderBy("language", "script")) - 1).alias("code"))


@query("EXP_13_knots", f"""WITH {PLACES}, p AS (SELECT radians(lon) * 6371 * cos(radians(42.5)) AS x, radians(lat) * 6371 AS y FROM places),
g AS (SELECT i * 100.0::DOUBLE AS kx, j * 100.0::DOUBLE AS ky FROM (SELECT unnest(generate_series(5, 16)) AS i), (SELECT unnest(generate_series(39, 53)) AS j))
SELECT kx, ky FROM g WHERE EXISTS (SELECT 1 FROM p WHERE power(x - kx, 2) + power(y - ky, 2) <= 100 * 100)""")
def knots(spark, folder):
    """Grid points at a spacing of 100 km that have a place within as much; places meet the corners around them."""
    h = 100.0
    p = places(spark, folder).select(S.plane_x(F.col("lon")).alias("x"), S.plane_y(F.col("lat")).alias("y"))
    near = p.select("x", "y", F.explode(F.sequence(F.floor(F.col("x") / h) - 1, F.floor(F.col("x") / h) + 2)).alias("i"))
    near = near.select("x", "y", "i", F.explode(F.sequence(F.floor(F.col("y") / h) - 1, F.floor(F.col("y") / h) + 2)).alias("j"))
    kx, ky = F.col("i") * h, F.col("j") * h
    hit = near.filter((F.pow(F.col("x") - kx, 2) + F.pow(F.col("y") - ky, 2) <= h * h) & F.col("i").between(5, 16) & F.col("j").between(39, 53))
    return hit.select(kx.alias("kx"), ky.alias("ky")).distinct()


@query("EXP_14_decoded", "WITH s AS (SELECT p_type AS v, min(p_partkey) AS k FROM part GROUP BY 1), d AS (SELECT v, row_number() OVER (ORDER BY k, v) AS code FROM s) SELECT p_partkey, code, v AS label FROM part JOIN d ON p_type = v")
def decoded(spark, folder):
    p = table(spark, folder, "part")
    d = hierarchy.dictionary(p, "p_partkey", "p_type")
    coded = p.join(d, p["p_type"] == d["value"]).select("p_partkey", "code")
    return coded.join(d, "code").select("p_partkey", "code", F.col("value").alias("label"))


@query("FLT_01_row_mask", "SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_size > 25")
def row_mask(spark, folder):
    return table(spark, folder, "part").filter("p_size % 2 = 0 and p_size > 25").select("p_partkey")


@query("FLT_11_class_windows", f"WITH {EXPANDED} SELECT script, count(*) AS n, round(sum(w), 6) AS mass FROM expanded WHERE (script = 'F' AND ord BETWEEN -20 AND -5) OR (script = 'O' AND ord >= -10) OR script = 'P' GROUP BY 1")
def class_windows(spark, folder):
    rows = intervals.expand(dated(spark, folder))
    keep = ((F.col("script") == "F") & F.col("ord").between(-20, -5)) | ((F.col("script") == "O") & (F.col("ord") >= -10)) | (F.col("script") == "P")
    return rows.filter(keep).groupBy("script").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("mass"))


@query("FLT_12_near_any", f"""WITH {PLACES}, t AS (SELECT lat AS lat2, lon AS lon2 FROM places WHERE place_id % 25 = 0),
d AS (SELECT place_id, 2 * 6371 * asin(least(1, sqrt(power(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin((radians(lon2) - radians(lon)) / 2), 2)))) AS km FROM places, t) SELECT DISTINCT place_id FROM d WHERE km <= 55""")
def near_any(spark, folder):
    p = places(spark, folder).select("place_id", "lat", "lon")
    t = p.filter("place_id % 25 = 0").select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return spatial.near(p, t, 55).select("place_id").distinct()


@query("JON_03_interval_join", f"WITH {DATED}, b AS (SELECT unnest(generate_series(-32, 11)) AS ord) SELECT b.ord::BIGINT AS ord, count(pk) AS n FROM b LEFT JOIN dated ON b.ord BETWEEN ord_start AND ord_end GROUP BY 1")
def interval_join(spark, folder):
    """Records by the bins of an axis that they touch, as an equi-join on exploded bins."""
    axis = spark.range(-32, 12).select(F.col("id").cast("int").alias("ord"))
    n = intervals.expand(dated(spark, folder), -32, 11).groupBy("ord").agg(F.count("*").alias("n"))
    return axis.join(n, "ord", "left").select("ord", F.coalesce("n", F.lit(0)).alias("n"))


@query("JON_05_expanded_keys", f"WITH {EXPANDED} SELECT language, script, ord::BIGINT AS ord, round(sum(w), 6) AS expected FROM expanded GROUP BY ALL")
def expanded_keys(spark, folder):
    """The expansion carries its record's columns, so no join goes back to them."""
    return intervals.timeline(dated(spark, folder), "language", "script").select("language", "script", "ord", F.round("expected", 6).alias("expected"))


@query("JON_14_attached_heads", f"""WITH {RECORDS}, {PLACES}, a AS (SELECT place_id, count(*) AS n FROM records GROUP BY 1), s AS (SELECT p.place_id, floor(lat)::BIGINT AS y, floor(lon)::BIGINT AS x, coalesce(n, 0) AS n FROM places p LEFT JOIN a USING (place_id)),
h AS (SELECT y, x, arg_min(place_id, (-n, place_id)) AS head FROM s GROUP BY ALL) SELECT s.place_id, head FROM s JOIN h USING (y, x) WHERE s.place_id <> head""")
def attached_heads(spark, folder):
    """Places of one spot go to the one with most records (the least of equal ones)."""
    a = records(spark, folder).groupBy("place_id").agg(F.count("*").alias("n"))
    s = places(spark, folder).join(a, "place_id", "left").select("place_id", F.floor("lat").alias("y"), F.floor("lon").alias("x"), F.coalesce("n", F.lit(0)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "place_id"))
    h = s.groupBy("y", "x").agg(best["place_id"].alias("head"))
    return s.join(h, ["y", "x"]).filter("place_id <> head").select("place_id", "head")


@query("SET_01_distinct_sorted", "SELECT p_type AS value, dense_rank() OVER (ORDER BY p_type) AS id FROM (SELECT DISTINCT p_type FROM part)")
def distinct_sorted(spark, folder):
    v = table(spark, folder, "part").select(F.col("p_type").alias("value")).distinct()
    return v.select("value", F.row_number().over(Window.orderBy("value")).alias("id"))


@query("SET_02_first_of_key", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_of_key(spark, folder):
    return table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SET_05_shared_parents", f"WITH {PLACES}, g AS (SELECT round(lat, 1) AS lat, round(lon, 0) AS lon, count(*) AS n, list(place_id ORDER BY place_id)[1] AS head FROM places GROUP BY 1, 2) SELECT place_id, CASE WHEN n > 1 AND head <> place_id THEN head END AS parent, n AS coord_shared FROM places JOIN g ON round(places.lat, 1) = g.lat AND round(places.lon, 0) = g.lon")
def shared_parents(spark, folder):
    by = Window.partitionBy(F.round("lat", 1), F.round("lon", 0))
    p = places(spark, folder).select("place_id", F.min("place_id").over(by).alias("head"), F.count("*").over(by).alias("coord_shared"))
    return p.select("place_id", F.when((F.col("coord_shared") > 1) & (F.col("head") != F.col("place_id")), F.col("head")).alias("parent"), "coord_shared")


@query("SET_07_united_sources", "SELECT kind, count(*) AS n, round(sum(v), 2) AS v FROM (SELECT 'customer' AS kind, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY 1")
def united_sources(spark, folder):
    c = table(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("v"))
    s = table(spark, folder, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("v"))
    return c.unionByName(s).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("v"))


@query("WIN_01_dense_ids", "SELECT n_name, row_number() OVER (ORDER BY n_name) AS id FROM nation")
def dense_ids(spark, folder):
    return table(spark, folder, "nation").select("n_name", F.row_number().over(Window.orderBy("n_name")).alias("id"))


@query("WIN_05_running_precision", "SELECT user_id, event_id, round(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w / count(*) OVER w, 6) AS precision_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)")
def running_precision(spark, folder):
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.sum((F.col("event_type") == "click").cast("int")).over(w) / F.count("*").over(w)
    return table(spark, folder, "events").select("user_id", "event_id", F.round(hit, 6).alias("precision_so_far"))


@query("SRT_01_multi_key", "SELECT p_partkey, n FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_size DESC, p_partkey) AS n FROM part) WHERE n <= 50")
def multi_key(spark, folder):
    order = ["p_brand", F.col("p_size").desc(), "p_partkey"]
    top = table(spark, folder, "part").orderBy(*order).limit(50)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(*order)).alias("n"))


@query("SRT_06_capped_layer", "SELECT p_partkey FROM part ORDER BY p_size, p_retailprice DESC, p_partkey LIMIT 40")
def capped_layer(spark, folder):
    return table(spark, folder, "part").orderBy("p_size", F.col("p_retailprice").desc(), "p_partkey").limit(40).select("p_partkey")


@query("SRT_07_facet_order", f"WITH {RECORDS} SELECT language, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, language) AS place FROM records GROUP BY language")
def facet_order(spark, folder):
    c = records(spark, folder).groupBy("language").agg(F.count("*").alias("n"))
    return c.select("language", "n", F.row_number().over(Window.orderBy(F.col("n").desc(), "language")).alias("place"))


@query("SRT_08_place_page", f"WITH {RECORDS} SELECT pk, row_number() OVER (PARTITION BY place_id ORDER BY date_start NULLS LAST, pk) AS n FROM records")
def place_page(spark, folder):
    by = Window.partitionBy("place_id").orderBy(F.col("date_start").asc_nulls_last(), "pk")
    return records(spark, folder).select("pk", F.row_number().over(by).alias("n"))


@query("SRT_09_gazetteer", f"WITH {PLACES} SELECT region::BIGINT AS region, place_id, row_number() OVER (PARTITION BY region ORDER BY name, place_id) AS n FROM places")
def gazetteer(spark, folder):
    by = Window.partitionBy("region").orderBy("name", "place_id")
    return places(spark, folder).select("region", "place_id", F.row_number().over(by).alias("n"))


@query("STR_02_damage_marks", r"""WITH t AS (SELECT doc_id, [text, replace(text, 'e', 'Ã©'), 'Å' || chr(129) || 'ódź', 'Îµ', 'Ð' || chr(176), 'â' || chr(128) || chr(153), 'Å la carte', text || '�'][doc_id % 8 + 1] AS s FROM documents)
SELECT doc_id, contains(s, '�') OR regexp_matches(s, '[ÂÃÅÎÐ][\x{80}-\x{bf}]|â\x{80}[\x{80}-\x{bf}]|â€') AS damaged FROM t""")
def damage_marks(spark, folder):
    from aeonframe.functions.unicode import looks_damaged

    texts = F.array("text", F.replace("text", F.lit("e"), F.lit("Ã©")), *(F.lit(x) for x in ("Å\x81ódź", "Îµ", "Ð°", "â\x80\x99", "Å la carte")), F.concat("text", F.lit("�")))
    return table(spark, folder, "documents").select("doc_id", looks_damaged(F.get(texts, (F.col("doc_id") % 8).cast("int"))).alias("damaged"))


@query("STR_03_encoding_audit")
def encoding_audit(spark, folder):
    d = table(spark, folder, "documents").select(F.col("source"), F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    return readers.encoding_audit(d)


@query("STR_11_name_forms", "SELECT n_nationkey::BIGINT AS n_nationkey, list_sort(list_distinct([lower(n_name), 'citta ' || lower(n_name)])) AS forms FROM nation")
def name_forms(spark, folder):
    """Forms of a name without stop words: the parts between slashes, and the whole."""
    stop = F.array(*(F.lit(x) for x in ("of", "the", "di", "la")))
    full = F.concat(F.lit("Citta di "), "n_name", F.lit("/"), "n_name")
    forms = F.transform(F.split(F.lower(full), "/"), lambda p: F.array_join(F.filter(F.split(p, " "), lambda w: ~F.array_contains(stop, w)), " "))
    return table(spark, folder, "nation").select("n_nationkey", F.array_sort(F.array_distinct(forms)).alias("forms"))
