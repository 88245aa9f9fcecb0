"""Document fingerprints by winnowing, in DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import partitions

SPACES = r"[\x20\x09-\x0D]+"
_PLACES = 24


def _neighbours(values: Column, step: int, combine) -> Column:
    """combine(values[i], values[i + step]) for each i that has both; an array too short stays as it is."""
    n = F.size(values)
    paired = F.zip_with(F.slice(values, F.lit(1), F.greatest(n - step, F.lit(0))), F.slice(values, F.lit(1 + step), F.greatest(n - step, F.lit(0))), combine)
    return F.when(n > step, paired).otherwise(values)


def _turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _joined(step: int):
    return lambda a, b: _turned(a, step).bitwiseXOR(b)


def fingerprints(df: DataFrame, text: str, name: str, k: int = 4, window: int = 16) -> DataFrame:
    """df with the column name: the winnowed fingerprint of a text column.

    A fingerprint is an array of longs, each a hash (39 bits) above the place
    of its run of words counted down from the top of 24 bits, so the least of
    a window is its least hash and of equal ones the rightmost. The hashes of
    runs of k words come from those of words by doubling: a run of 2n words
    is its first half, turned by n bits, with its second half (a cyclic
    polynomial). The minima of windows of `window` runs come by doubling, too.

    Each window of `window` runs keeps one: two texts that share
    window + k - 1 words in a row share a hash. A text with fewer words than k
    or fewer runs than a window is one run or one window. A null, an empty
    text and one of white space have an empty fingerprint. Places beyond
    2**24 words repeat. k and window are powers of 2.
    """
    hashes = F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn(name, hashes)
    step = 1
    while step < k:
        df = df.withColumn(name, _neighbours(F.col(name), step, _joined(step)))
        step *= 2
    top = (1 << _PLACES) - 1
    placed = F.transform(F.col(name), lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - 39), _PLACES).bitwiseOR(F.lit(top) - i.cast("long").bitwiseAND(F.lit(top))))
    df = df.withColumn(name, placed)
    step = 1
    while step < window:
        df = df.withColumn(name, _neighbours(F.col(name), step, lambda a, b: F.least(a, b)))
        step *= 2
    return df.withColumn(name, F.array_distinct(name))


def printed(fingerprint: Column) -> Column:
    """hash@place, comma-joined, by place."""
    top = (1 << _PLACES) - 1
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws("@", F.shiftrightunsigned(x, _PLACES).cast("string"), (F.lit(top) - x.bitwiseAND(F.lit(top))).cast("string"))), ",")


def hashes_of(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, _PLACES)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints, whatever their places; of two empty ones 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(documents: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """documents with `next`, a struct of the columns of the row with the next smaller id; after the last comes the first.

    Rows are dealt by ranges of ids that hold about as many rows each,
    whatever the ids (cut points are approximate quantiles); the first row of a
    range is also dealt to the range before it, so each range finds all its
    followers in itself, and no task sees more than a range. Equal ids follow
    one another by the columns and share a range; null ids come last.
    """
    key, near = F.col(id_col).cast("decimal(38,0)"), F.col(id_col).cast("double")
    parts = 4 * partitions(documents.sparkSession)
    found = documents.agg(F.percentile_approx(near, [i / parts for i in range(1, parts)], 10_000) if parts > 1 else F.lit(None)).first()[0]
    cuts = sorted(set(found or []), reverse=True)
    # As many cuts are above an id as ranges are before its own; they are counted by groups, then in one group.
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)] or [[]]
    above = lambda values: F.size(F.filter(values, lambda c: c > near))
    whole = above(F.lit([g[-1] for g in groups])) if cuts else F.lit(0)
    inner = above(F.get(F.array(*(F.lit(g) for g in groups)), whole)) if cuts else F.lit(0)
    raw = F.when(key.isNull(), len(cuts) + 1).otherwise(F.least(whole * width + F.greatest(inner, F.lit(0)), F.lit(len(cuts)))).cast("int")
    numbered = documents.withColumn("_raw", raw)
    filled = sorted(numbered.groupBy("_raw").agg(F.max(key).alias("top")).collect())
    ranges, tops = [0] * (len(cuts) + 2), [top for _, top in filled]
    for n, (r, _) in enumerate(filled):
        ranges[r] = n
    listed = lambda values: F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",")  # noqa: E731  folded to one constant
    rows = numbered.withColumn("_range", F.get(listed(ranges), F.col("_raw")).cast("int")).drop("_raw")
    order = [F.col(id_col).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in columns[:1]]]
    top = F.get(listed(tops), F.col("_range")).try_cast("decimal(38,0)")
    also = F.when(key.eqNullSafe(top), F.pmod(F.col("_range") - 1, F.lit(max(1, len(tops)))))
    # The lent copy stands behind the rows of its new range.
    lent = rows.filter(also.isNotNull()).withColumn("_range", also).withColumn("_lent", F.lit(1))
    both = rows.withColumn("_lent", F.lit(0)).unionByName(lent)
    by_range = Window.partitionBy("_range").orderBy("_lent", *order)
    return both.withColumn("next", F.lead(F.struct(*columns)).over(by_range)).filter("_lent = 0").drop("_range", "_lent")


def fingerprinted(documents: DataFrame, k: int = 4, window: int = 16) -> DataFrame:
    """Fingerprints of each text of documents (doc_id, text) and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many of the next document by falling doc_id (or all it has).
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text is an empty one. One document is its
    own next. Rows that share an id follow one another by their texts, those
    without one come last. Other columns are left alone; no documents give no
    rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = fingerprints(docs, "text", "own", k, window).withColumn("n_chars", F.length("text").cast("long"))
    paired = with_next(docs, ["text", "own"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half))
    paired = fingerprints(paired.withColumn("edited", edited), "edited", "other", k, window)
    own = hashes_of(F.col("own"))
    return paired.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"), printed(F.col("other")).alias("edited_fingerprint"),
        likeness(own, hashes_of(F.col("other"))).alias("near_edited"), likeness(own, hashes_of(F.col("next.own"))).alias("near_next"),
    )
