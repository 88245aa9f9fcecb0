"""Full-text search: an inverted index, and any, all, phrase and prefix queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aeonframe.functions.scalars import plain_letters


def index(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(token, key, column, position) of the words of the columns, folded to lower case without accents."""
    parts = []
    for c in columns:
        words = F.filter(F.split(F.lower(plain_letters(F.col(c).cast("string"))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        parts.append(rows.select(F.col(key), F.lit(c).alias("column"), F.posexplode(words).alias("position", "token")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("token", key, "column", "position")


def any_of(postings: DataFrame, key: str, *tokens: str) -> DataFrame:
    return postings.filter(F.col("token").isin(*tokens)).select(key).distinct()


def all_of(postings: DataFrame, key: str, *tokens: str) -> DataFrame:
    hits = postings.filter(F.col("token").isin(*tokens)).groupBy(key).agg(F.count_distinct("token").alias("_n"))
    return hits.filter(F.col("_n") == len(set(tokens))).select(key)


def phrase(postings: DataFrame, key: str, *tokens: str) -> DataFrame:
    """Rows where the tokens stand in this order with nothing between: equal differences of place and number."""
    numbered = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(tokens))))
    hits = postings.filter(F.col("token").isin(*tokens)).select("*", numbered.alias("w")).filter("token = w.t")
    starts = hits.groupBy(key, "column", (F.col("position") - F.col("w.i")).alias("start")).agg(F.count_distinct("w.i").alias("n"))
    return starts.filter(F.col("n") == len(tokens)).select(key).distinct()


def prefix(postings: DataFrame, key: str, start: str) -> DataFrame:
    return postings.filter(F.col("token").startswith(start)).select(key).distinct()
