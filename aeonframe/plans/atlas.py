"""Queries of strings, facets, joins, hierarchies, geometry and search."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from aeonframe.functions import scalars as S
from aeonframe.operators import facets, hierarchy, search, spatial
from aeonframe.operators.quantiles import values_at

from .model import DATED, PLACES, RECORDS, dated, places, records, table
from .registry import query

_REQUEST = facets.Request({"language": ["1-URGENT", "2-HIGH"], "script": ["F", "O"]}, (-25, -10))


@query("FLT_04_faceted_filter", f"WITH {DATED} SELECT pk, language, script, ord_start::BIGINT AS ord_start FROM dated WHERE language IN ('1-URGENT', '2-HIGH') AND script IN ('F', 'O') AND ord_start BETWEEN -25 AND -10")
def faceted_filter(spark, folder):
    return facets.selected(dated(spark, folder), _REQUEST).select("pk", "language", "script", "ord_start")


@query("AGG_13_facet_counts", f"""
WITH {DATED}
SELECT 'language' AS facet, language AS value, count(*) AS n FROM dated WHERE script IN ('F', 'O') AND ord_start BETWEEN -25 AND -10 GROUP BY ALL
UNION ALL SELECT 'script', script, count(*) FROM dated WHERE language IN ('1-URGENT', '2-HIGH') AND ord_start BETWEEN -25 AND -10 GROUP BY ALL""")
def facet_counts(spark, folder):
    return facets.facet_counts(dated(spark, folder), _REQUEST, ["language", "script"])


@query("FLT_05_text_haystack", "SELECT c_custkey AS pk FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), '7 auto')")
def text_haystack(spark, folder):
    request = facets.Request(text="7 AUTO", searched=("c_name", "c_mktsegment"))
    return facets.selected(table(spark, folder, "customer"), request).select(F.col("c_custkey").alias("pk"))


@query("FLT_13_empty_facet", f"WITH {RECORDS} SELECT count(*) FILTER (false) AS none_on, count(*) AS all_on FROM records")
def empty_facet(spark, folder):
    """An empty set matches nothing; switching the last value on asks for all again."""
    r = records(spark, folder)
    none = facets.Request({"script": []})
    every = facets.Request({"script": ["F", "O"]}).toggled("script", "P", ["F", "O", "P"])
    return facets.selected(r, none).agg(F.count("*").alias("none_on")).crossJoin(F.broadcast(facets.selected(r, every).agg(F.count("*").alias("all_on"))))


@query("FLT_09_pooled_levels", "WITH n AS (SELECT p_type, count(*) OVER (PARTITION BY p_type) AS n FROM part) SELECT CASE WHEN n < 20 THEN 'other type' ELSE p_type END AS p_type, count(*) AS n FROM n GROUP BY 1")
def pooled_levels(spark, folder):
    return facets.pooled(table(spark, folder, "part"), "p_type", 20, "other type").groupBy("p_type").agg(F.count("*").alias("n"))


@query("FLT_06_fulltext_all", """
WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM documents)
SELECT doc_id FROM t WHERE token IN ('license', 'version') GROUP BY doc_id HAVING count(DISTINCT token) = 2""")
def fulltext_all(spark, folder):
    return search.all_of(search.index(table(spark, folder, "documents"), "doc_id", "text"), "doc_id", "license", "version")


@query("FLT_06_fulltext_phrase", """
WITH t AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS s FROM documents)
SELECT doc_id FROM t WHERE contains(s, ' apache license version ')""")
def fulltext_phrase(spark, folder):
    return search.phrase(search.index(table(spark, folder, "documents"), "doc_id", "text"), "doc_id", "apache", "license", "version")


@query("FLT_06_fulltext_prefix", """
WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM documents)
SELECT DISTINCT doc_id FROM t WHERE starts_with(token, 'licens')""")
def fulltext_prefix(spark, folder):
    return search.prefix(search.index(table(spark, folder, "documents"), "doc_id", "text"), "doc_id", "licens")


@query("FLT_07_central_box", f"""
WITH {PLACES}, n AS (SELECT count(*) AS n FROM places),
x AS (SELECT lon, row_number() OVER (ORDER BY lon) AS i FROM places), y AS (SELECT lat, row_number() OVER (ORDER BY lat) AS i FROM places)
SELECT (SELECT lon FROM x, n WHERE i = floor(n * 0.005) + 1) AS west, (SELECT lat FROM y, n WHERE i = floor(n * 0.005) + 1) AS south,
       (SELECT lon FROM x, n WHERE i = greatest(floor(n * 0.995), 1)) AS east, (SELECT lat FROM y, n WHERE i = greatest(floor(n * 0.995), 1)) AS north""")
def central_box(spark, folder):
    return spatial.central_box(places(spark, folder), "lon", "lat")


@query("FLT_03_coordinate_sanity", f"WITH {PLACES} SELECT count(*) AS n, count(*) FILTER (lat BETWEEN 37 AND 45 AND lon BETWEEN 8 AND 17) AS sane FROM places")
def coordinate_sanity(spark, folder):
    p = places(spark, folder)
    sane = F.when(F.col("lat").between(37, 45) & F.col("lon").between(8, 17), F.col("lat"))
    return p.agg(F.count("*").alias("n"), F.count(sane).alias("sane"))


@query("STR_04_clean_strings", """
WITH t AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN ' N/A ' WHEN c_custkey % 7 = 0 THEN '  a   b ' ELSE c_mktsegment END AS s FROM customer)
SELECT CASE WHEN lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) NOT IN ('', 'na', 'n/a', 'nan', 'null', 'none', '<na>', '-') THEN trim(regexp_replace(s, '\\s+', ' ', 'g')) END AS cleaned, count(*) AS n FROM t GROUP BY 1""")
def clean_strings(spark, folder):
    k = F.col("c_custkey")
    dirty = F.when(k % 5 == 0, " N/A ").when(k % 7 == 0, "  a   b ").otherwise(F.col("c_mktsegment"))
    return table(spark, folder, "customer").groupBy(S.text(dirty).alias("cleaned")).agg(F.count("*").alias("n"))


@query("STR_05_tolerant_numbers", """
WITH t AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_size || '.5 ' WHEN p_partkey % 4 = 1 THEN 'abc' WHEN p_partkey % 4 = 2 THEN '' ELSE p_retailprice::VARCHAR END AS s, p_partkey FROM part)
SELECT p_partkey, CAST(round_even(TRY_CAST(trim(s) AS DOUBLE), 0) AS BIGINT) AS n, TRY_CAST(trim(s) AS DOUBLE) AS d FROM t""")
def tolerant_numbers(spark, folder):
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 "))).when(k % 4 == 1, "abc").when(k % 4 == 2, "").otherwise(F.col("p_retailprice").cast("string"))
    return table(spark, folder, "part").select(k, S.whole(s).alias("n"), S.number(s).alias("d"))


def _slug(x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"coalesce(nullif({s}, ''), 'unnamed')"


@query("STR_06_slugs", f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' (' || p_brand || ')' WHEN 1 THEN 'Ḥatra ß ' || p_partkey WHEN 2 THEN ' Ṭāyôn — ' || p_size || ' …è' ELSE '日本' END AS s FROM part)
SELECT p_partkey, {_slug("s")} AS slug FROM t""")
def slugs(spark, folder):
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).when(k % 4 == 1, F.concat(F.lit("Ḥatra ß "), k.cast("string")))
    s = s.when(k % 4 == 2, F.concat(F.lit(" Ṭāyôn — "), F.col("p_size").cast("string"), F.lit(" …è"))).otherwise(F.lit("日本"))
    return table(spark, folder, "part").select(k, S.slug(s).alias("slug"))


_FLAGGED = ["", " (?)", "?", " ? ( ? ) ", " [Found & written]", " [found&written]?", ", - ", " (?) nord", "? [ found & written ]"]


@query("STR_07_place_flags", rf"""
WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN '(?)' ELSE c_name || [{", ".join(f"'{x}'" for x in _FLAGGED)}][c_custkey % {len(_FLAGGED)} + 1] END AS s FROM customer),
b AS (SELECT c_custkey, s, regexp_replace(s, '\s*\[\s*found\s*&\s*written\s*\]\s*', ' ', 'gi') AS b FROM t),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(b, '\s*\(\s*\?\s*\)\s*$|\s*\?\s*$', ''), '\s+', ' ', 'g'), '^[ ,-]+|[ ,-]+$', '', 'g') AS n FROM b)
SELECT c_custkey, CASE WHEN n = '' THEN trim(s) ELSE n END AS name, regexp_matches(b, '\(\s*\?\s*\)\s*$|\?\s*$')::BIGINT AS uncertain, regexp_matches(s, '\[\s*found\s*&\s*written\s*\]', 'i')::BIGINT AS found FROM n""")
def place_flags(spark, folder):
    k = F.col("c_custkey")
    s = F.when(k % 50 == 0, "(?)").otherwise(F.concat("c_name", F.get(F.array(*map(F.lit, _FLAGGED)), (k % len(_FLAGGED)).cast("int"))))
    f = S.place_flags(s)
    return table(spark, folder, "customer").select(k, f["name"].alias("name"), f["uncertain"].cast("long").alias("uncertain"), f["found"].cast("long").alias("found"))


_VARIANTS = rf"""list_sort(list_distinct([v FOR v IN [{_slug("x")} FOR x IN list_concat([NAME], string_split_regex(NAME, '\s*/\s*'),
flatten([regexp_extract_all(c, '\(([^)]*)\)', 1) FOR c IN string_split_regex(NAME, '\s*/\s*')]), [regexp_replace(c, '\s*\([^)]*\)', '', 'g') FOR c IN string_split_regex(NAME, '\s*/\s*')])] IF length(v) > 2 AND v <> 'unnamed']))"""
_KNOWN_AS = [" / {} antica (x{})", " (Este)", "", " / (ab) / Città {}", " (vs/{})"]


@query("STR_08_name_variants", f"""
WITH t AS (SELECT n_nationkey, CASE n_nationkey % {len(_KNOWN_AS)} {" ".join(f"WHEN {i} THEN n_name || '" + x.replace("{}", "' || n_name || '") + "'" for i, x in enumerate(_KNOWN_AS))} END AS name FROM nation)
SELECT n_nationkey::BIGINT AS n_nationkey, {_VARIANTS.replace("NAME", "name")} AS variants FROM t""")
def name_variants(spark, folder):
    k, name = F.col("n_nationkey"), F.col("n_name")
    known = F.array(*(F.concat(name, F.regexp_replace(F.lit(x), r"\{\}", name)) for x in _KNOWN_AS))
    return table(spark, folder, "nation").select(k, S.name_variants(F.get(known, k % len(_KNOWN_AS))).alias("variants"))


_LEVELS = ["Roma, Tomba {}", "Necropoli di {}", "{}, Campo", "{}", "Sepolcro 3 {}", "cimitero di {}", "{} - Via Nova", "T. 4, {}", "Este - tumulo {}", "Sepolcreto {}", "Tombolo {}", "grave {}"]


@query("STR_09_place_levels", rf"""
WITH t AS (SELECT p_partkey, replace([{", ".join(f"'{x}'" for x in _LEVELS)}][p_partkey % {len(_LEVELS)} + 1], '{{}}', p_brand) AS s FROM part),
l AS (SELECT p_partkey, s, trim(string_split_regex(s, '\s*[,-]\s*')[-1]) AS tail FROM t)
SELECT p_partkey, CASE WHEN regexp_matches(tail, '^(t\b|t\.|tomba|tomb\b|tumulo|sepolcr|grave\b|hypogeum)', 'i') OR regexp_matches(s, '^(t\b|t\.|tomba|tomb\b|tumulo|sepolcr|grave\b|hypogeum)', 'i') THEN 'tomb'
WHEN regexp_matches(s, 'necropol|cimitero|cemeter|sepolcret', 'i') THEN 'necropolis' WHEN contains(s, ',') OR regexp_matches(s, '\s-\s') THEN 'locality' ELSE 'site' END AS level FROM l""")
def place_levels(spark, folder):
    k = F.col("p_partkey")
    s = F.replace(F.get(F.array(*map(F.lit, _LEVELS)), (k % len(_LEVELS)).cast("int")), F.lit("{}"), F.col("p_brand"))
    return table(spark, folder, "part").select(k, S.place_level(s).alias("level"))


@query("STR_13_code_labels", "SELECT c_custkey, coalesce(n_name, 'Nation ' || c_nationkey) AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey")
def code_labels(spark, folder):
    codes = table(spark, folder, "nation").filter("n_nationkey % 3 <> 0")
    c = table(spark, folder, "customer").join(codes, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", F.coalesce("n_name", F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))).alias("label"))


@query("STR_14_code_schemes", "SELECT CASE WHEN regexp_full_match(s, '-?\\d+') THEN 'numeric' ELSE 'descriptive' END AS scheme, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_type END AS s FROM part) GROUP BY 1")
def code_schemes(spark, folder):
    s = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_type"))
    return table(spark, folder, "part").groupBy(S.code_scheme(s).alias("scheme")).agg(F.count("*").alias("n"))


@query("STR_15_property_pick", """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def property_pick(spark, folder):
    props = F.from_json("props", "map<string,string>")
    return table(spark, folder, "events").select("event_id", S.first_property(props, "name", "K").alias("k"))


@query("STR_16_word_counts", """SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '<[^>]*>|\\\\[a-zA-Z]+|[{}$]', ' ', 'g'), '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))) AS words FROM documents""")
def word_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", S.word_count(F.col("text")).alias("words"))


@query("STR_17_series", "SELECT regexp_extract(p_brand, '^([A-Za-z]+)#', 1) AS series, regexp_extract(p_brand, '([0-9]+)$', 1) AS number, count(*) AS n FROM part GROUP BY ALL")
def series(spark, folder):
    return table(spark, folder, "part").groupBy(F.regexp_extract("p_brand", "^([A-Za-z]+)#", 1).alias("series"), F.regexp_extract("p_brand", "([0-9]+)$", 1).alias("number")).agg(F.count("*").alias("n"))


@query("STR_18_family_indicator", "SELECT regexp_matches(lower(o_orderpriority), 'urgent|high') AS family, count(*) AS n FROM orders GROUP BY 1")
def family_indicator(spark, folder):
    return table(spark, folder, "orders").groupBy(F.lower("o_orderpriority").rlike("urgent|high").alias("family")).agg(F.count("*").alias("n"))


@query("SRC_15_scraped_links", """SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def scraped_links(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("HSH_01_digests", "SELECT doc_id, sha256(text) AS sha256, substr(sha1(text), 1, 6) AS suffix FROM documents")
def digests(spark, folder):
    b = F.col("text").cast("binary")
    return table(spark, folder, "documents").select("doc_id", F.sha2(b, 256).alias("sha256"), F.substring(F.sha1(b), 1, 6).alias("suffix"))


@query("JSN_01_json_fields", "SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_fields(spark, folder):
    return table(spark, folder, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("MTH_01_plane", f"WITH {PLACES} SELECT place_id, round(radians(lon) * 6371 * cos(radians(42.5)), 6) AS x, round(radians(lat) * 6371, 6) AS y FROM places")
def plane(spark, folder):
    return places(spark, folder).select("place_id", F.round(S.plane_x(F.col("lon")), 6).alias("x"), F.round(S.plane_y(F.col("lat")), 6).alias("y"))


@query("MTH_02_haversine", f"""WITH {PLACES} SELECT place_id, round(2 * 6371 * asin(least(1, sqrt(power(sin((radians(lat) - radians(41.9)) / 2), 2) + cos(radians(41.9)) * cos(radians(lat)) * power(sin((radians(lon) - radians(12.5)) / 2), 2)))), 6) AS km FROM places""")
def haversine(spark, folder):
    return places(spark, folder).select("place_id", F.round(S.haversine(F.lit(41.9), F.lit(12.5), F.col("lat"), F.col("lon")), 6).alias("km"))


@query("MTH_04_signed_log", "SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS v FROM customer")
def signed_log(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.round(S.signed_log1p(F.col("c_acctbal")), 6).alias("v"))


@query("MTH_05_softmax", "WITH e AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT user_id, event_type, round(exp(v / 50) / sum(exp(v / 50)) OVER (PARTITION BY user_id), 6) AS p FROM e")
def softmax(spark, folder):
    e = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    x = F.exp(F.col("v") / 50)
    return e.select("user_id", "event_type", F.round(x / F.sum(x).over(Window.partitionBy("user_id")), 6).alias("p"))


@query("MTH_07_percentile_index", "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events) SELECT max(value) FILTER (i = floor((n - 1) * 0.05) + 1) AS low, max(value) FILTER (i = floor((n - 1) * 0.95) + 1) AS high FROM v")
def percentile_index(spark, folder):
    """By index in the sorted values, not interpolated."""
    found = values_at(table(spark, folder, "events"), "value", lambda n: [(n - 1) * 0.05 + 1, (n - 1) * 0.95 + 1])
    return spark.createDataFrame([tuple(found)], "low double, high double")


@query("JON_01_star", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def star(spark, folder):
    t = lambda n: table(spark, folder, n)
    # nation and region have fixed sizes; Spark decides on customer by its size.
    dims = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("JON_02_place_counts", f"WITH {RECORDS}, {PLACES} SELECT p.place_id, p.name, count(r.pk) AS n, min(date_start)::BIGINT AS first, max(date_end)::BIGINT AS last FROM places p LEFT JOIN records r USING (place_id) GROUP BY ALL")
def place_counts(spark, folder):
    p = places(spark, folder).select("place_id", "name")
    agg = records(spark, folder).groupBy("place_id").agg(F.count("*").alias("n"), F.min("date_start").alias("first"), F.max("date_end").alias("last"))
    return p.join(agg, "place_id", "left").select("place_id", "name", F.coalesce("n", F.lit(0)).alias("n"), "first", "last")


@query("JON_04_place_tree", f"WITH {PLACES} SELECT c.place_id, c.name, p.name AS parent FROM places c LEFT JOIN places p ON c.parent_id = p.place_id")
def place_tree(spark, folder):
    p = places(spark, folder)
    up = p.select(F.col("place_id").alias("up"), F.col("name").alias("parent"))
    return p.join(up, p["parent_id"] == up["up"], "left").select("place_id", "name", "parent")


@query("JON_06_alternate_key", "SELECT s_suppkey, coalesce(a.c_custkey, b.c_custkey) AS c_custkey FROM supplier LEFT JOIN customer a ON s_suppkey * 7 = a.c_custkey LEFT JOIN customer b ON b.c_name = 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0')")
def alternate_key(spark, folder):
    s, c = table(spark, folder, "supplier"), table(spark, folder, "customer")
    a = c.select(F.col("c_custkey").alias("ka"))
    b = c.select(F.col("c_custkey").alias("kb"), F.col("c_name").alias("nb"))
    s = s.join(a, F.col("s_suppkey") * 7 == F.col("ka"), "left").join(b, F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")) == F.col("nb"), "left")
    return s.select("s_suppkey", F.coalesce("ka", "kb").alias("c_custkey"))


_NEAR = f"""WITH {PLACES},
a AS (SELECT place_id, lat, lon FROM places), b AS (SELECT s_suppkey AS target, (s_suppkey * 7907) % 1000 / 100.0::DOUBLE + 36 AS lat2, (s_suppkey * 104711) % 1100 / 100.0::DOUBLE + 7 AS lon2 FROM supplier),
d AS (SELECT place_id, target, 2 * 6371 * asin(least(1, sqrt(power(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin((radians(lon2) - radians(lon)) / 2), 2)))) AS km FROM a, b)
"""


def _targets(spark, folder):
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(k.alias("target"), ((k * 7907) % 1000 / F.lit(100.0) + 36).alias("lat2"), ((k * 104711) % 1100 / F.lit(100.0) + 7).alias("lon2"))


@query("JON_08_best_within_radius", _NEAR + "SELECT place_id, arg_min(target, (round(km, 6), target)) AS target, round(min(km), 6) AS km FROM d WHERE km <= 30 GROUP BY place_id")
def best_within_radius(spark, folder):
    return spatial.best_within(places(spark, folder).select("place_id", "lat", "lon"), _targets(spark, folder), "place_id", 30)


@query("JON_09_nearest_distance", _NEAR + "SELECT place_id, round(min(km), 6) AS km FROM d WHERE km <= 60 GROUP BY place_id")
def nearest_distance(spark, folder):
    return spatial.nearest(places(spark, folder).select("place_id", "lat", "lon"), _targets(spark, folder), "place_id", 60).select("place_id", F.round("km", 6).alias("km"))


@query("JON_10_nearest_other", f"""WITH {PLACES}, p AS (SELECT place_id, radians(lon) * 6371 * cos(radians(42.5)) AS x, radians(lat) * 6371 AS y FROM places),
t AS (SELECT * FROM p)
SELECT p.place_id, round(min(sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2))), 6) AS km FROM p JOIN t ON p.place_id <> t.place_id GROUP BY p.place_id""")
def nearest_other(spark, folder):
    p = places(spark, folder).select("place_id", S.plane_x(F.col("lon")).alias("x"), S.plane_y(F.col("lat")).alias("y"))
    return spatial.nearest_other(p, "place_id").select("place_id", F.round("km", 6).alias("km"))


_RING = [(8.0, 37.0), (17.0, 38.0), (15.0, 45.0), (11.0, 41.0), (8.5, 45.5)]


@query("JON_11_point_in_polygon", f"""WITH {PLACES},
v AS (SELECT * FROM (VALUES {", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(_RING))}) t(i, x, y)),
s AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.i = (a.i + 1) % {len(_RING)}),
h AS (SELECT place_id, count(*) FILTER (((y1 > lat) <> (y2 > lat)) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) AS n FROM places, s GROUP BY place_id)
SELECT place_id, n % 2 = 1 AS inside FROM h""")
def point_in_polygon(spark, folder):
    ring = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(_RING)], "ring int, i int, lon double, lat double")
    return spatial.inside(places(spark, folder), spatial.edges(ring, "ring", "i", "lon", "lat"), "place_id")


@query("JON_13_shared_coordinates", f"WITH {PLACES} SELECT round(lat, 0) AS lat, round(lon, 0) AS lon, count(*) AS n, min(place_id) AS head FROM places GROUP BY 1, 2 HAVING count(*) > 1")
def shared_coordinates(spark, folder):
    g = places(spark, folder).groupBy(F.round("lat", 0).alias("lat"), F.round("lon", 0).alias("lon")).agg(F.count("*").alias("n"), F.min("place_id").alias("head"))
    return g.filter("n > 1")


@query("JON_15_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS has_large FROM customer")
def semi_anti(spark, folder):
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders").filter("o_totalprice > 100000")
    on = c["c_custkey"] == o["o_custkey"]
    return c.join(o, on, "left_semi").select("c_custkey", F.lit(True).alias("has_large")).unionByName(c.join(o, on, "left_anti").select("c_custkey", F.lit(False).alias("has_large")))


@query("JON_16_snapped_cells", f"WITH {PLACES} SELECT round_even(lat / 0.25, 0) * 0.25::DOUBLE AS lat, round_even(lon / 0.25, 0) * 0.25::DOUBLE AS lon, count(*) AS n FROM places GROUP BY 1, 2")
def snapped_cells(spark, folder):
    return places(spark, folder).groupBy(spatial.snapped(F.col("lat")).alias("lat"), spatial.snapped(F.col("lon")).alias("lon")).agg(F.count("*").alias("n"))


@query("JON_18_outbound_links", "SELECT c_custkey, 'https://example.org/' || coalesce(s_name, c_name) AS uri FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def outbound_links(spark, folder):
    c, s = table(spark, folder, "customer"), table(spark, folder, "supplier")
    return c.join(s, c["c_custkey"] == s["s_suppkey"], "left").select("c_custkey", F.concat(F.lit("https://example.org/"), F.coalesce("s_name", "c_name")).alias("uri"))


@query("AGG_01_zero_filled", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def zero_filled(spark, folder):
    c = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("c"))
    return table(spark, folder, "nation").join(c, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("c", F.lit(0)).alias("n"))


@query("AGG_07_centroids", f"WITH {PLACES} SELECT region::BIGINT AS region, round_even(avg(lat), 6) AS lat, round_even(avg(lon), 6) AS lon FROM places GROUP BY 1")
def centroids(spark, folder):
    return places(spark, folder).groupBy("region").agg(F.bround(F.avg("lat"), 6).alias("lat"), F.bround(F.avg("lon"), 6).alias("lon"))


@query("AGG_08_conditional_sums", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def conditional_sums(spark, folder):
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))


@query("AGG_09_distinct_having", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 HAVING n > 3")
def distinct_having(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n")).filter("n > 3")


@query("AGG_10_cross_tab", "SELECT c_mktsegment, c_nationkey::BIGINT AS c_nationkey, count(*) AS n FROM customer GROUP BY ALL HAVING n > 1")
def cross_tab(spark, folder):
    return table(spark, folder, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).filter("n > 1")


@query("AGG_11_place_languages", f"""WITH {RECORDS}, c AS (SELECT place_id, language, count(*) AS c FROM records GROUP BY ALL)
SELECT place_id, sum(c)::BIGINT AS n, arg_min(language, (-c, language)) AS main, list_sort(list(language || '=' || c)) AS counts FROM c GROUP BY place_id""")
def place_languages(spark, folder):
    m = hierarchy.language_maps(records(spark, folder), "place_id", "language")
    return m.select("place_id", "n", "main", F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("counts"))


@query("AGG_12_hierarchy_fold", f"""WITH {RECORDS}, {PLACES}, a AS (SELECT place_id, count(*) AS n, min(date_start) AS first, max(date_end) AS last FROM records GROUP BY 1),
f AS (SELECT coalesce(parent_id, place_id) AS place_id, coalesce(n, 0) AS n, first, last FROM places LEFT JOIN a USING (place_id))
SELECT place_id, sum(n)::BIGINT AS n, min(first)::BIGINT AS first, max(last)::BIGINT AS last, count(*) AS rolled FROM f GROUP BY 1""")
def hierarchy_fold(spark, folder):
    a = records(spark, folder).groupBy("place_id").agg(F.count("*").alias("n"), F.min("date_start").alias("first"), F.max("date_end").alias("last"))
    p = places(spark, folder).join(a, "place_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return hierarchy.folded(p, "place_id", "parent_id", ["n"], ["first"], ["last"])


@query("AGG_16_corpus_stats", f"WITH {RECORDS} SELECT count(*) AS n, count(DISTINCT place_id) AS places, count(*) FILTER (date_start IS NOT NULL OR date_end IS NOT NULL) AS dated, min(date_start)::BIGINT AS first, max(date_end)::BIGINT AS last FROM records")
def corpus_stats(spark, folder):
    return records(spark, folder).agg(F.count("*").alias("n"), F.count_distinct("place_id").alias("places"), F.count_if(F.col("date_start").isNotNull() | F.col("date_end").isNotNull()).alias("dated"), F.min("date_start").alias("first"), F.max("date_end").alias("last"))


@query("AGG_33_bin_quantiles", "SELECT l_linenumber::BIGINT AS l_linenumber, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.1), 4) AS low, round(quantile_cont(l_extendedprice, 0.9), 4) AS high FROM lineitem GROUP BY 1")
def bin_quantiles(spark, folder):
    q = lambda p: F.round(F.percentile("l_extendedprice", p), 4)
    return table(spark, folder, "lineitem").groupBy("l_linenumber").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), q(0.1).alias("low"), q(0.9).alias("high"))


@query("AGG_29_correlation", "SELECT c_mktsegment, round(corr(c_acctbal, o_totalprice), 6) AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def correlation(spark, folder):
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_mktsegment").agg(F.round(F.corr("c_acctbal", "o_totalprice"), 6).alias("r"), F.count("*").alias("n"))


@query("AGG_31_band_means", f"WITH {RECORDS}, {PLACES} SELECT floor(lat)::BIGINT AS band, language, round(avg(r.value), 4) AS mean FROM records r JOIN places USING (place_id) GROUP BY 1, 2")
def band_means(spark, folder):
    r = records(spark, folder).join(places(spark, folder).select("place_id", "lat"), "place_id")
    return r.groupBy(F.floor("lat").alias("band"), "language").agg(F.round(F.avg("value"), 4).alias("mean"))


@query("AGG_32_dominant", f"""WITH {RECORDS}, {PLACES}, c AS (SELECT floor(lat)::BIGINT AS band, language, count(*) AS c FROM records JOIN places USING (place_id) GROUP BY 1, 2)
SELECT band, arg_min(language, (-c, language)) AS main, round(max(c) / sum(c), 6) AS share FROM c GROUP BY band""")
def dominant(spark, folder):
    c = records(spark, folder).join(places(spark, folder).select("place_id", "lat"), "place_id").groupBy(F.floor("lat").alias("band"), "language").agg(F.count("*").alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("c"), "language"))
    return c.groupBy("band").agg(best["language"].alias("main"), F.round(F.max("c") / F.sum("c"), 6).alias("share"))


@query("AGG_39_fractional_membership", "WITH f AS (SELECT p_partkey, list_filter(['MO', 'M', 'LARGE', 'ONO'], lambda x: contains(p_type, x)) AS f FROM part), e AS (SELECT unnest(CASE WHEN len(f) = 0 THEN ['other'] ELSE f END) AS family, 1.0::DOUBLE / greatest(len(f), 1) AS w FROM f) SELECT family, round(sum(w), 6) AS mass FROM e GROUP BY 1")
def fractional_membership(spark, folder):
    names = F.array(*(F.lit(x) for x in ("MO", "M", "LARGE", "ONO")))
    f = F.filter(names, lambda x: F.col("p_type").contains(x))
    p = table(spark, folder, "part").select(F.when(F.size(f) == 0, F.array(F.lit("other"))).otherwise(f).alias("f"))
    return p.select(F.explode("f").alias("family"), (1.0 / F.size("f")).alias("w")).groupBy("family").agg(F.round(F.sum("w"), 6).alias("mass"))


@query("EXP_05_dictionary", "WITH s AS (SELECT p_type AS value, min(p_partkey) AS k FROM part WHERE p_type <> '' GROUP BY 1) SELECT value, row_number() OVER (ORDER BY k, value) AS code FROM s")
def dictionary(spark, folder):
    return hierarchy.dictionary(table(spark, folder, "part"), "p_partkey", "p_type")


@query("EXP_09_tiles", "WITH x AS (SELECT unnest(generate_series(0, 2)) AS i), y AS (SELECT unnest(generate_series(0, 2)) AS j) SELECT 7 + 4.0::DOUBLE * i AS west, 36 + 4.0::DOUBLE * j AS south, least(7 + 4.0::DOUBLE * (i + 1), 18) AS east, least(36 + 4.0::DOUBLE * (j + 1), 47) AS north FROM x, y")
def tiles(spark, folder):
    return spark.createDataFrame(spatial.tiles(7.0, 36.0, 18.0, 47.0, 4.0), "west double, south double, east double, north double")


@query("EXP_10_coarse_grid", f"WITH {PLACES} SELECT floor(lat / 0.5)::BIGINT AS y, floor(lon / 0.5)::BIGINT AS x, count(*) AS n, round(sum(value), 2) AS value FROM places GROUP BY 1, 2")
def coarse_grid(spark, folder):
    return places(spark, folder).groupBy(F.floor(F.col("lat") / 0.5).alias("y"), F.floor(F.col("lon") / 0.5).alias("x")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("EXP_11_spatial_blocks", f"WITH {PLACES} SELECT CASE WHEN lat >= 44 THEN 'north' WHEN lon >= 14 THEN 'east' WHEN lat < 39 THEN 'south' ELSE 'centre' END AS block, count(*) AS n FROM places GROUP BY 1")
def spatial_blocks(spark, folder):
    block = F.when(F.col("lat") >= 44, "north").when(F.col("lon") >= 14, "east").when(F.col("lat") < 39, "south").otherwise("centre")
    return places(spark, folder).groupBy(block.alias("block")).agg(F.count("*").alias("n"))


@query("SET_09_upsert", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def upsert(spark, folder):
    return hierarchy.latest(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("SET_06_unique_slugs", "WITH s AS (SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS slug, p_size FROM part), a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY p_partkey) = 1 THEN slug ELSE slug || '-' || p_size END AS s1 FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p_partkey) AS n FROM a) SELECT p_partkey, CASE WHEN n = 1 THEN s1 ELSE s1 || '-' || substr(sha1(p_partkey::VARCHAR), 1, 6) END AS \"unique\" FROM b")
def unique_slugs(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", S.slug(F.col("p_brand")).alias("slug"), "p_size")
    return hierarchy.unique_slugs(p, "p_partkey", "slug", "p_size").select("p_partkey", "unique")


@query("SET_03_duplicate_ids", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("SET_08_id_lists", "(SELECT c_custkey AS k, 'only customers' AS side FROM customer EXCEPT SELECT o_custkey, 'only customers' FROM orders) UNION ALL (SELECT c_custkey, 'both' FROM customer INTERSECT SELECT o_custkey, 'both' FROM orders)")
def id_lists(spark, folder):
    c, o = table(spark, folder, "customer").select(F.col("c_custkey").alias("k")), table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    return c.exceptAll(o.distinct()).withColumn("side", F.lit("only customers")).unionByName(c.intersect(o).withColumn("side", F.lit("both")))


@query("SET_10_manifest_merge", "SELECT coalesce(a.k, b.k)::BIGINT AS k, coalesce(b.v, a.v) AS v, b.k IS NOT NULL AS rebuilt FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_nationkey > 10) b ON a.k = b.k")
def manifest_merge(spark, folder):
    n = table(spark, folder, "nation")
    old = n.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    new = n.filter("n_nationkey > 10").select(F.col("n_nationkey").alias("k2"), F.lower("n_name").alias("v2"))
    return old.join(new, F.col("k") == F.col("k2"), "full").select(F.coalesce("k", "k2").alias("k"), F.coalesce("v2", "v").alias("v"), F.col("k2").isNotNull().alias("rebuilt"))


@query("WIN_02_surrogate_keys", "WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS id FROM customer) SELECT c_custkey, coalesce(id, (SELECT max(id) FROM t) + row_number() OVER (PARTITION BY id IS NULL ORDER BY c_custkey)) AS id FROM t")
def surrogate_keys(spark, folder):
    t = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("id"))
    top = t.agg(F.max("id").alias("top"))
    lacking = t.filter("id is null").withColumn("n", F.row_number().over(Window.orderBy("c_custkey"))).crossJoin(F.broadcast(top))  # one row
    return t.filter("id is not null").unionByName(lacking.select("c_custkey", (F.col("top") + F.col("n")).alias("id")))


@query("WIN_04_tied_ranks", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) + (count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) - 1) / 2.0::DOUBLE AS tied_rank FROM customer")
def tied_ranks(spark, folder):
    rank = F.rank().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment"))
    ties = F.count("*").over(Window.partitionBy("c_nationkey", "c_mktsegment"))
    return table(spark, folder, "customer").select("c_custkey", (rank + (ties - 1) / F.lit(2.0)).alias("tied_rank"))


@query("WIN_07_top_children", "SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_children(spark, folder):
    by = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("n")).filter("n <= 3")


@query("WIN_08_runs_at_gaps", "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events), r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, run::BIGINT AS run, count(*) AS n FROM r GROUP BY ALL")
def runs_at_gaps(spark, folder):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events").withColumn("cut", F.when(F.col("ts") - F.lag("ts").over(by) <= F.expr("INTERVAL 6 HOURS"), 0).otherwise(1))
    e = e.withColumn("run", F.sum("cut").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "run").agg(F.count("*").alias("n"))


@query("SRT_02_nulls_last", f"WITH {RECORDS} SELECT pk, row_number() OVER (ORDER BY date_start DESC NULLS LAST, pk) AS place FROM records QUALIFY place <= 100")
def nulls_last(spark, folder):
    top = records(spark, folder).orderBy(F.col("date_start").desc_nulls_last(), "pk").limit(100)
    return top.select("pk", F.row_number().over(Window.orderBy(F.col("date_start").desc_nulls_last(), "pk")).alias("place"))


@query("SRT_03_paging", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 200")
def paging(spark, folder):
    return table(spark, folder, "orders").orderBy("o_totalprice", "o_orderkey").offset(200).limit(100).select("o_orderkey")


@query("SRT_04_richest", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20")
def richest(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(20)


@query("GEO_05_bounding_boxes", f"WITH {PLACES} SELECT region::BIGINT AS region, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM places GROUP BY 1")
def bounding_boxes(spark, folder):
    return places(spark, folder).groupBy("region").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


@query("ARR_02_shared_members", "WITH o AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1) SELECT o_custkey, len(list_intersect(p, ['1-URGENT', '2-HIGH'])) AS shared FROM o WHERE list_has_any(p, ['1-URGENT', '2-HIGH'])")
def shared_members(spark, folder):
    wanted = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return o.filter(F.arrays_overlap("p", wanted)).select("o_custkey", F.size(F.array_intersect("p", wanted)).alias("shared"))


@query("ARR_01_vector_norms", "SELECT vec_id, len(embedding) AS n, round(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]), 4) AS squares FROM embeddings")
def vector_norms(spark, folder):
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.round(squares, 4).alias("squares"))
