"""Queries of interval expansion and of what is summed over it."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from aeonframe.functions import scalars as S
from aeonframe.operators import entropy, intervals

from .model import DATED, EXPANDED, RECORDS, dated, records
from .registry import query


@query("EXP_01_aoristic_timeline", f"""
WITH {EXPANDED}
SELECT language, ord::BIGINT AS ord, count(*) AS possible, round(sum(w), 6) AS expected, round(sqrt(sum(w * (1 - w))), 6) AS sd FROM expanded GROUP BY ALL""")
def aoristic_timeline(spark, folder):
    t = intervals.timeline(dated(spark, folder), "language")
    return t.select("language", "ord", "possible", F.round("expected", 6).alias("expected"), F.round("sd", 6).alias("sd"))


@query("EXP_01_clamped_axis", f"""
WITH {EXPANDED}
SELECT script, round(sum(w), 6) AS mass, count(*) AS n, count(DISTINCT pk) AS records FROM expanded WHERE ord BETWEEN -20 AND -5 GROUP BY script""")
def clamped_axis(spark, folder):
    rows = intervals.expand(dated(spark, folder), -20, -5)
    return rows.groupBy("script").agg(F.round(F.sum("w"), 6).alias("mass"), F.count("*").alias("n"), F.count_distinct("pk").alias("records"))


@query("EXP_02_axis", f"""
WITH {EXPANDED},
seen AS (SELECT ord FROM expanded GROUP BY ord HAVING sum(w) >= 0.5 UNION SELECT ord_start FROM dated WHERE ord_start IS NOT NULL),
bins AS (SELECT unnest(generate_series(min(ord), max(ord))) AS ord FROM seen),
edges AS (SELECT ord, CASE WHEN ord < 0 THEN ord * 25 ELSE ord * 25 + 1 END AS edge FROM bins)
SELECT ord::BIGINT AS ord, edge::BIGINT AS edge,
       CASE WHEN edge < 0 THEN (-edge) || '–' || (-edge - 24) || ' BC' ELSE 'AD ' || edge || '–' || (edge + 24) END AS label FROM edges""")
def axis(spark, folder):
    return intervals.axis(dated(spark, folder))


@query("EXP_03_century_expansion", f"""
WITH {EXPANDED}
SELECT language, CAST(floor((CASE WHEN ord < 0 THEN ord * 25 ELSE ord * 25 + 1 END) / 100.0) AS BIGINT) AS century, round(sum(w), 6) AS mass FROM expanded GROUP BY ALL""")
def century_expansion(spark, folder):
    rows = intervals.expand(dated(spark, folder))
    return rows.groupBy("language", S.bin_century(S.ordinal_edge(F.col("ord"))).alias("century")).agg(F.round(F.sum("w"), 6).alias("mass"))


_OVERLAP = f"""
WITH {RECORDS},
spans AS (SELECT pk, date_start::DOUBLE AS lo, CASE WHEN date_end <= date_start THEN date_start + 1 ELSE date_end END::DOUBLE AS hi FROM records WHERE date_start IS NOT NULL AND date_end IS NOT NULL),
bins AS (SELECT *, unnest(generate_series(CAST(floor(lo / 25) AS BIGINT), CAST(floor(hi / 25) AS BIGINT))) AS b FROM spans),
weights AS (SELECT pk, b * 25 AS bin_start, greatest(least(hi, (b + 1) * 25.0::DOUBLE) - greatest(lo, b * 25.0::DOUBLE), 0) / DIVISOR AS weight FROM bins)
SELECT bin_start::BIGINT AS bin_start, count(*) AS n, round(sum(weight), 6) AS weight FROM weights WHERE weight > 1e-9 GROUP BY bin_start"""


@query("EXP_04_overlap_event", _OVERLAP.replace("DIVISOR", "(hi - lo)"))
def overlap_event(spark, folder):
    rows = intervals.overlap_weights(records(spark, folder), "date_start", "date_end", "event")
    return rows.groupBy("bin_start").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("EXP_04_overlap_presence", _OVERLAP.replace("DIVISOR", "25.0::DOUBLE"))
def overlap_presence(spark, folder):
    rows = intervals.overlap_weights(records(spark, folder), "date_start", "date_end", "presence")
    return rows.groupBy("bin_start").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("AGG_24_presence_max", f"""
WITH {RECORDS},
spans AS (SELECT place_id, date_start::DOUBLE AS lo, CASE WHEN date_end <= date_start THEN date_start + 1 ELSE date_end END::DOUBLE AS hi FROM records WHERE date_start IS NOT NULL AND date_end IS NOT NULL),
bins AS (SELECT *, unnest(generate_series(CAST(floor(lo / 25) AS BIGINT), CAST(floor(hi / 25) AS BIGINT))) AS b FROM spans),
weights AS (SELECT place_id, b * 25 AS bin_start, greatest(least(hi, (b + 1) * 25.0::DOUBLE) - greatest(lo, b * 25.0::DOUBLE), 0) / 25.0::DOUBLE AS weight FROM bins)
SELECT place_id, bin_start::BIGINT AS bin_start, round(max(weight), 6) AS weight FROM weights WHERE weight > 1e-9 GROUP BY ALL""")
def presence_max(spark, folder):
    rows = intervals.overlap_weights(records(spark, folder), "date_start", "date_end", "presence")
    return rows.groupBy("place_id", "bin_start").agg(F.round(F.max("weight"), 6).alias("weight"))


@query("EXP_06_merged_periods", f"""
WITH {RECORDS},
p AS (SELECT place_id, date_start AS a, greatest(date_end, date_start) AS b FROM records WHERE date_start IS NOT NULL AND date_end IS NOT NULL),
m AS (SELECT *, max(b) OVER (PARTITION BY place_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY place_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT place_id, min(a)::BIGINT AS a, max(b)::BIGINT AS b, count(*) AS n_periods FROM r GROUP BY place_id, run""")
def merged_periods(spark, folder):
    p = records(spark, folder).filter("date_start is not null and date_end is not null").select("place_id", F.col("date_start").alias("a"), F.greatest("date_end", "date_start").alias("b"))
    return intervals.merged_runs(p, "place_id", "a", "b")


@query("EXP_07_heaping", f"""
WITH {RECORDS}, n AS (SELECT pk, date_start, count(*) OVER (PARTITION BY date_start) AS n FROM records WHERE date_start IS NOT NULL)
SELECT CASE WHEN n <= 5 THEN 5 WHEN n <= 50 THEN 12 ELSE 25 END::BIGINT AS halfwidth, count(*) AS records, count(DISTINCT date_start) AS years FROM n GROUP BY 1""")
def heaping(spark, folder):
    rows = intervals.heaping_halfwidth(records(spark, folder).filter("date_start is not null"), "date_start")
    return rows.groupBy("halfwidth").agg(F.count("*").alias("records"), F.count_distinct("date_start").alias("years"))


@query("EXP_08_interval_mean", f"""
WITH {EXPANDED}
SELECT pk, round(avg(power(ord, 2)), 6) AS mean_basis FROM expanded GROUP BY pk""")
def interval_mean(spark, folder):
    """The mean of a basis function (here the square of the bin) over each record's interval."""
    rows = intervals.expand(dated(spark, folder))
    return rows.groupBy("pk").agg(F.round(F.avg(F.pow(F.col("ord"), 2)), 6).alias("mean_basis"))


@query("AGG_02_start_timeline", f"WITH {DATED} SELECT language, ord_start::BIGINT AS ord, count(*) AS n FROM dated WHERE ord_start IS NOT NULL GROUP BY ALL")
def start_timeline(spark, folder):
    return intervals.start_timeline(dated(spark, folder), "language")


@query("AGG_14_timeline_by_language", f"""
WITH {EXPANDED}
SELECT coalesce(nullif(language, '1-URGENT'), '0') AS language, ord::BIGINT AS ord, round(sum(w), 6) AS expected FROM expanded WHERE script = 'O' GROUP BY ALL""")
def timeline_by_language(spark, folder):
    """All facets but the time window; records without a language are of language 0."""
    rows = dated(spark, folder).filter("script = 'O'").withColumn("language", F.coalesce(F.nullif("language", F.lit("1-URGENT")), F.lit("0")))
    return intervals.timeline(rows, "language").select("language", "ord", F.round("expected", 6).alias("expected"))


@query("AGG_17_conditional_entropy", f"""
WITH {EXPANDED},
c AS (SELECT language, ord, sum(w) AS n, sum(CASE WHEN script = 'O' THEN w ELSE 0 END) AS y FROM expanded GROUP BY ALL),
p AS (SELECT n, greatest(least(y / n, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS p FROM c)
SELECT round(sum(n * -(p * log2(p) + (1 - p) * log2(1 - p))) / sum(n), 6) AS bits, round(sum(n), 6) AS mass FROM p""")
def conditional_entropy(spark, folder):
    rows = intervals.expand(dated(spark, folder)).withColumn("y", (F.col("script") == "O").cast("double"))
    return entropy.conditional(rows, ["language", "ord"], "y", "w").select(F.round("bits", 6).alias("bits"), F.round("mass", 6).alias("mass"))


@query("AGG_18_held_out_entropy", f"""
WITH {EXPANDED},
f AS (SELECT *, place_id % 5 AS fold, CASE WHEN script = 'O' THEN 1.0::DOUBLE ELSE 0 END AS y FROM expanded),
cell AS (SELECT fold, language, ord, sum(w) AS n, sum(w * y) AS s FROM f GROUP BY ALL),
alls AS (SELECT language, ord, sum(n) AS n, sum(s) AS s FROM cell GROUP BY ALL),
tot AS (SELECT sum(n) AS n, sum(s) AS s FROM cell),
fold AS (SELECT fold, sum(n) AS n, sum(s) AS s FROM cell GROUP BY fold),
sc AS (SELECT c.n, c.s, greatest(least((a.s - c.s + 2.0 * (tot.s - fd.s) / (tot.n - fd.n)) / (a.n - c.n + 2.0), 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS p
       FROM cell c JOIN alls a USING (language, ord) JOIN fold fd USING (fold) CROSS JOIN tot)
SELECT round(-sum(s * log2(p) + (n - s) * log2(1 - p)) / sum(n), 6) AS bits FROM sc""")
def held_out_entropy(spark, folder):
    rows = intervals.expand(dated(spark, folder)).withColumn("y", (F.col("script") == "O").cast("double")).withColumn("fold", F.col("place_id") % 5)
    return entropy.held_out(rows, ["language", "ord"], "y", "w", "fold").select(F.round("bits", 6).alias("bits"))


@query("AGG_20_trajectories", f"""
WITH {EXPANDED},
c AS (SELECT language, CAST(floor((CASE WHEN ord < 0 THEN ord * 25 ELSE ord * 25 + 1 END) / 100.0) AS BIGINT) AS century, sum(w) AS n, sum(CASE WHEN script = 'O' THEN w ELSE 0 END) AS y FROM expanded GROUP BY ALL HAVING sum(w) >= 20),
p AS (SELECT *, y / n AS share, greatest(least(y / n, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS q FROM c)
SELECT language, century, round(n, 6) AS mass, round(share, 6) AS share, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) AS bits FROM p""")
def trajectories(spark, folder):
    rows = intervals.expand(dated(spark, folder)).withColumn("y", (F.col("script") == "O").cast("double")).withColumn("century", S.bin_century(S.ordinal_edge(F.col("ord"))))
    t = entropy.cells(rows, ["language", "century"], "y", "w").filter("mass >= 20")
    return t.select("language", "century", F.round("mass", 6).alias("mass"), F.round("share", 6).alias("share"), F.round(S.entropy_bits(F.col("share")), 6).alias("bits"))


@query("AGG_21_narrow_and_aoristic", f"""
WITH {EXPANDED},
e AS (SELECT language, CAST(floor((CASE WHEN ord < 0 THEN ord * 25 ELSE ord * 25 + 1 END) / 100.0) AS BIGINT) AS century, w, b - a <= 100 AS narrow, CASE WHEN script = 'O' THEN w ELSE 0 END AS yw FROM expanded)
SELECT language, century, round(sum(yw) / sum(w), 6) AS rate, round(sum(CASE WHEN narrow THEN yw END) / sum(CASE WHEN narrow THEN w END), 6) AS narrow_rate, round(power(sum(w), 2) / sum(w * w), 6) AS n_eff
FROM e GROUP BY ALL HAVING power(sum(w), 2) / sum(w * w) >= 15 AND sum(CASE WHEN narrow THEN w END) > 0""")
def narrow_and_aoristic(spark, folder):
    d = dated(spark, folder).withColumn("narrow", F.abs(F.coalesce("date_end", "date_start") - F.coalesce("date_start", "date_end")) <= 100)
    rows = intervals.expand(d).withColumn("century", S.bin_century(S.ordinal_edge(F.col("ord")))).withColumn("yw", F.when(F.col("script") == "O", F.col("w")).otherwise(0.0))
    n_eff = F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w"))
    of = lambda c: F.sum(F.when(F.col("narrow"), F.col(c)))
    t = rows.groupBy("language", "century").agg((F.sum("yw") / F.sum("w")).alias("rate"), F.try_divide(of("yw"), of("w")).alias("narrow_rate"), n_eff.alias("n_eff"), of("w").alias("nw"))
    return t.filter("n_eff >= 15 and nw > 0").select("language", "century", *(F.round(c, 6).alias(c) for c in ("rate", "narrow_rate", "n_eff")))


@query("AGG_22_top_shares", f"""
WITH {EXPANDED},
c AS (SELECT CAST(floor((CASE WHEN ord < 0 THEN ord * 25 ELSE ord * 25 + 1 END) / 100.0) AS BIGINT) AS century, language, sum(w) AS m FROM expanded GROUP BY ALL),
r AS (SELECT *, m / sum(m) OVER (PARTITION BY century) AS share, row_number() OVER (PARTITION BY century ORDER BY round(m, 9) DESC, language) AS place FROM c)
SELECT century, place, language, round(share, 6) AS share FROM r WHERE place <= 3""")
def top_shares(spark, folder):
    rows = intervals.expand(dated(spark, folder)).withColumn("century", S.bin_century(S.ordinal_edge(F.col("ord"))))
    c = rows.groupBy("century", "language").agg(F.sum("w").alias("m"))
    by = Window.partitionBy("century")
    c = c.withColumn("share", F.col("m") / F.sum("m").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.round("m", 9).desc(), "language")))
    return c.filter("place <= 3").select("century", "place", "language", F.round("share", 6).alias("share"))


@query("AGG_30_bin_shares", f"""
WITH {EXPANDED}, c AS (SELECT ord, language, sum(w) AS m FROM expanded GROUP BY ALL)
SELECT ord::BIGINT AS ord, language, round(m / sum(m) OVER (PARTITION BY ord), 6) AS share FROM c""")
def bin_shares(spark, folder):
    c = intervals.expand(dated(spark, folder)).groupBy("ord", "language").agg(F.sum("w").alias("m"))
    return c.select("ord", "language", F.round(F.col("m") / F.sum("m").over(Window.partitionBy("ord")), 6).alias("share"))


@query("AGG_40_century_mean", f"""
WITH {EXPANDED}, y AS (SELECT language, abs(CASE WHEN ord < 0 THEN ord * 25 ELSE ord * 25 + 1 END) AS y, w, value FROM expanded)
SELECT language, ((y - 1) // 100 + 1)::BIGINT AS century, round(sum(value * w) / sum(w), 4) AS mean FROM y GROUP BY ALL""")
def century_mean(spark, folder):
    rows = intervals.expand(dated(spark, folder)).withColumn("century", F.floor((F.abs(S.ordinal_edge(F.col("ord"))) - 1) / 100) + 1)
    return rows.groupBy("language", "century").agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 4).alias("mean"))


@query("AGG_41_code_entropy", f"""
WITH {RECORDS}, c AS (SELECT script, language, count(*) AS n FROM records GROUP BY ALL), s AS (SELECT script, n, n / sum(n) OVER (PARTITION BY script) AS p FROM c)
SELECT script, sum(n)::BIGINT AS n, round(-sum(p * log2(p)), 6) AS bits FROM s GROUP BY script HAVING sum(n) >= 20""")
def code_entropy(spark, folder):
    return entropy.of_codes(records(spark, folder), ["script"], "language", 20).select("script", "n", F.round("bits", 6).alias("bits"))


@query("AGG_44_pivot_entropy", f"""
WITH {RECORDS}, d AS (SELECT language, CASE WHEN date_start < 0 THEN -((-date_start + 99) // 100) ELSE (date_start - 1) // 100 + 1 END AS century, script FROM records WHERE date_start IS NOT NULL),
c AS (SELECT language, century, count(*) FILTER (script = 'F') AS f, count(*) FILTER (script = 'O') AS o, count(*) FILTER (script = 'P') AS p, count(*) AS n FROM d GROUP BY ALL HAVING count(*) >= 20)
SELECT language, century::BIGINT AS century, f, o, p, round(-(CASE WHEN f > 0 THEN f / n * log2(f / n) ELSE 0 END + CASE WHEN o > 0 THEN o / n * log2(o / n) ELSE 0 END + CASE WHEN p > 0 THEN p / n * log2(p / n) ELSE 0 END), 6) AS bits FROM c""")
def pivot_entropy(spark, folder):
    d = records(spark, folder).filter("date_start is not null").withColumn("century", S.century(F.col("date_start")))
    c = d.groupBy("language", "century").pivot("script", ["F", "O", "P"]).count().na.fill(0)
    n = F.col("F") + F.col("O") + F.col("P")
    part = lambda x: F.when(F.col(x) > 0, F.col(x) / n * F.log2(F.col(x) / n)).otherwise(0.0)
    return c.filter(n >= 20).select("language", "century", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"), F.round(-(part("F") + part("O") + part("P")), 6).alias("bits"))


@query("DAT_02_bins_and_labels", f"""
WITH {RECORDS}, e AS (SELECT date_start AS y, CASE WHEN date_start < 0 THEN -(((-date_start + 24) // 25) * 25) ELSE CAST(floor((date_start - 1) / 25.0) AS BIGINT) * 25 + 1 END AS edge FROM records WHERE date_start IS NOT NULL)
SELECT y::BIGINT AS y, edge::BIGINT AS edge, CASE WHEN edge < 0 THEN (-edge) || '–' || (-edge - 24) || ' BC' ELSE 'AD ' || edge || '–' || (edge + 24) END AS label,
       CASE WHEN y < 0 THEN (-y) || ' BC' ELSE 'AD ' || y END AS year_label, count(*) AS n FROM e GROUP BY ALL""")
def bins_and_labels(spark, folder):
    y = F.col("date_start")
    edge = S.bin_edge(y)
    return records(spark, folder).filter(y.isNotNull()).groupBy(y.alias("y"), edge.alias("edge"), S.bin_label(edge).alias("label"), S.year_label(y).alias("year_label")).agg(F.count("*").alias("n"))


@query("DAT_04_midpoint_century", f"""
WITH {RECORDS}, m AS (SELECT CAST(round_even((coalesce(date_start, date_end) + coalesce(date_end, date_start)) / 2.0, 0) AS BIGINT) AS mid FROM records)
SELECT mid, CASE WHEN mid < 0 THEN -((-mid + 99) // 100) ELSE CAST(floor((mid - 1) / 100.0) AS BIGINT) + 1 END AS century, count(*) AS n FROM m GROUP BY ALL""")
def midpoint_century(spark, folder):
    mid = S.midpoint(F.col("date_start"), F.col("date_end"))
    return records(spark, folder).groupBy(mid.alias("mid"), S.century(mid).alias("century")).agg(F.count("*").alias("n"))


@query("DAT_06_interpolated_series", f"""
WITH {EXPANDED}, s AS (SELECT language, ord, sum(w) AS v FROM expanded GROUP BY ALL)
SELECT language, ord::BIGINT AS ord, round(v + 0.4 * (coalesce(lead(v) OVER (PARTITION BY language ORDER BY ord), v) - v), 6) AS interpolated FROM s""")
def interpolated_series(spark, folder):
    s = intervals.expand(dated(spark, folder)).groupBy("language", "ord").agg(F.sum("w").alias("v"))
    return intervals.interpolate(s, "language", "ord", "v", F.lit(0.4)).select("language", "ord", F.round("interpolated", 6).alias("interpolated"))


@query("FLT_08_narrow_dated", f"WITH {RECORDS} SELECT language, count(*) AS n, count(*) FILTER (date_end - date_start <= 100) AS narrow FROM records WHERE date_start IS NOT NULL AND date_end IS NOT NULL GROUP BY language")
def narrow_dated(spark, folder):
    r = records(spark, folder).filter("date_start is not null and date_end is not null")
    return r.groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("date_end") - F.col("date_start") <= 100).alias("narrow"))


@query("FLT_16_window_clip", f"""
WITH {DATED}
SELECT count(*) AS all_records, count(*) FILTER (ord_start IS NULL) AS undated, count(*) FILTER (ord_start IS NOT NULL AND greatest(ord_start, -20) <= least(ord_end, -5)) AS kept,
       round(sum(CASE WHEN ord_start IS NOT NULL AND greatest(ord_start, -20) <= least(ord_end, -5) THEN (least(ord_end, -5) - greatest(ord_start, -20) + 1) / n_bins::DOUBLE END), 6) AS mass FROM dated""")
def window_clip(spark, folder):
    a, b = F.greatest("ord_start", F.lit(-20)), F.least("ord_end", F.lit(-5))
    kept = F.col("ord_start").isNotNull() & (a <= b)
    d = dated(spark, folder)
    return d.agg(F.count("*").alias("all_records"), F.count_if(F.col("ord_start").isNull()).alias("undated"), F.count_if(kept).alias("kept"), F.round(F.sum(F.when(kept, (b - a + 1) / F.col("n_bins"))), 6).alias("mass"))


@query("AGG_34_width_histogram", f"""
WITH {RECORDS}, w AS (SELECT date_end - date_start AS w FROM records WHERE date_start IS NOT NULL AND date_end IS NOT NULL)
SELECT CASE WHEN w <= 0 THEN '0' WHEN w <= 25 THEN '1-25' WHEN w <= 50 THEN '26-50' WHEN w <= 100 THEN '51-100' WHEN w <= 200 THEN '101-200' ELSE 'over 200' END AS width, count(*) AS n FROM w GROUP BY 1""")
def width_histogram(spark, folder):
    w = F.col("date_end") - F.col("date_start")
    width = F.when(w <= 0, "0").when(w <= 25, "1-25").when(w <= 50, "26-50").when(w <= 100, "51-100").when(w <= 200, "101-200").otherwise("over 200")
    return records(spark, folder).filter(w.isNotNull()).groupBy(width.alias("width")).agg(F.count("*").alias("n"))


@query("AGG_36_coverage", f"""
WITH {RECORDS}
SELECT language, count(*) AS n, count(date_start) AS with_start, count(*) FILTER (date_start IS NOT NULL AND date_end IS NOT NULL) AS both_ends, median(date_end - date_start)::DOUBLE AS median_width,
       round(100.0::DOUBLE * count(*) FILTER (date_end - date_start > 100) / count(*) FILTER (date_end - date_start IS NOT NULL), 4) AS percent_wide FROM records GROUP BY language""")
def coverage(spark, folder):
    w = F.col("date_end") - F.col("date_start")
    return records(spark, folder).groupBy("language").agg(
        F.count("*").alias("n"), F.count("date_start").alias("with_start"), F.count_if(w.isNotNull()).alias("both_ends"), F.percentile(w, 0.5).alias("median_width"), F.round(100.0 * F.count_if(w > 100) / F.count_if(w.isNotNull()), 4).alias("percent_wide")
    )


@query("WIN_03_running_mass", f"""
WITH {EXPANDED}, s AS (SELECT language, ord, sum(w) AS v FROM expanded GROUP BY ALL)
SELECT language, ord::BIGINT AS ord, round(sum(v) OVER (PARTITION BY language ORDER BY ord ROWS UNBOUNDED PRECEDING), 5) AS running FROM s""")
def running_mass(spark, folder):
    s = intervals.expand(dated(spark, folder)).groupBy("language", "ord").agg(F.sum("w").alias("v"))
    order = Window.partitionBy("language").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("language", "ord", F.round(F.sum("v").over(order), 5).alias("running"))


@query("AGG_47_trajectory_bands", f"""
WITH {EXPANDED}, c AS (SELECT language, ord, place_id % 20 AS draw, sum(w) AS n, sum(CASE WHEN script = 'O' THEN w ELSE 0 END) AS y FROM expanded GROUP BY ALL),
m AS (SELECT language, ord, sum(n) AS mass, count(*) AS draws, quantile_cont(y / n, 0.1) AS low, quantile_cont(y / n, 0.9) AS high FROM c GROUP BY ALL)
SELECT language, ord::BIGINT AS ord, round(mass, 6) AS mass, draws, round(low, 6) AS low, round(high, 6) AS high FROM m WHERE mass >= 3""")
def trajectory_bands(spark, folder):
    """Percentile bands over draws (here groups of places), where a cell has mass 3."""
    rows = intervals.expand(dated(spark, folder)).withColumn("y", (F.col("script") == "O").cast("double")).withColumn("draw", F.col("place_id") % 20)
    c = entropy.cells(rows, ["language", "ord", "draw"], "y", "w")
    m = c.groupBy("language", "ord").agg(F.sum("mass").alias("mass"), F.count("*").alias("draws"), F.percentile("share", 0.1).alias("low"), F.percentile("share", 0.9).alias("high"))
    return m.filter("mass >= 3").select("language", "ord", F.round("mass", 6).alias("mass"), "draws", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("AGG_23_source_cell_mass", f"""
WITH {RECORDS},
spans AS (SELECT script, place_id, date_start::DOUBLE AS lo, CASE WHEN date_end <= date_start THEN date_start + 1 ELSE date_end END::DOUBLE AS hi FROM records WHERE date_start IS NOT NULL AND date_end IS NOT NULL),
bins AS (SELECT *, unnest(generate_series(CAST(floor(lo / 25) AS BIGINT), CAST(floor(hi / 25) AS BIGINT))) AS b FROM spans),
weights AS (SELECT script, place_id, b * 25 AS bin_start, sum(greatest(least(hi, (b + 1) * 25.0::DOUBLE) - greatest(lo, b * 25.0::DOUBLE), 0) / 25.0::DOUBLE) AS weight FROM bins GROUP BY ALL)
SELECT script, bin_start::BIGINT AS bin_start, round(sum(least(weight, 1)), 6) AS mass FROM weights WHERE weight > 0 GROUP BY ALL""")
def source_cell_mass(spark, folder):
    rows = intervals.overlap_weights(records(spark, folder), "date_start", "date_end", "presence", keep=0.0)
    site = rows.groupBy("script", "place_id", "bin_start").agg(F.sum("weight").alias("weight"))
    return site.groupBy("script", "bin_start").agg(F.round(F.sum(F.least("weight", F.lit(1.0))), 6).alias("mass"))


@query("AGG_35_first_attested", f"""
WITH {EXPANDED}, c AS (SELECT language, ord, sum(w) AS m FROM expanded GROUP BY ALL)
SELECT language, min(ord) FILTER (m > 1)::BIGINT AS first_ord, round(max(m), 6) AS peak FROM c GROUP BY language""")
def first_attested(spark, folder):
    c = intervals.expand(dated(spark, folder)).groupBy("language", "ord").agg(F.sum("w").alias("m"))
    return c.groupBy("language").agg(F.min(F.when(F.col("m") > 1, F.col("ord"))).alias("first_ord"), F.round(F.max("m"), 6).alias("peak"))
