"""String functions that need all of Unicode or Python's own algorithms, as Arrow functions over distinct values."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


@F.pandas_udf(T.StringType())
def fold(names: pd.Series) -> pd.Series:
    """Without accents and parentheses, lower case, letters and digits only, one space between."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", re.sub(r"\([^)]*\)", " ", s)) if not unicodedata.combining(c))
        return " ".join(re.sub(r"[^a-z0-9]+", " ", bare.lower()).split())

    return names.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def repair(texts: pd.Series) -> pd.Series:
    """Text whose UTF-8 bytes were read as Latin-1 or Windows-1252, up to three times over."""

    def one(s: str | None) -> str | None:
        if s is None or s.isascii():
            return s
        for _ in range(3):
            for codec in ("latin-1", "cp1252"):
                try:
                    again = s.encode(codec).decode("utf-8")
                    break
                except UnicodeError:
                    again = s
            if again == s:
                break
            s = again
        return s

    return texts.map(one, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 for equal names, Ratcliff-Obershelp's ratio else, at least 0.9 where one holds the other."""

    def one(x: str | None, y: str | None) -> float:
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        ratio = difflib.SequenceMatcher(None, x, y).ratio()
        return max(ratio, 0.9) if (x in y or y in x) and min(len(x), len(y)) >= 4 else ratio

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def over_distinct(df: DataFrame, column: str, function, name: str) -> DataFrame:
    """df with name = function(column), computed once a distinct value and joined back."""
    values = df.select(F.col(column).alias("_v")).distinct().withColumn(name, function(F.col("_v")))
    return df.join(values, df[column].eqNullSafe(values["_v"]), "left").drop("_v")


def looks_damaged(c: Column) -> Column:
    """Marks of UTF-8 read as Latin-1 (a lead sign and one that follows it), as Windows-1252, or of lost characters."""
    return c.rlike("[ÂÃÅÎÐ][\u0080-\u00bf]|â\u0080[\u0080-\u00bf]|â€|�")
