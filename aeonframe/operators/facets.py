"""Faceted filters and the counts beside them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class Request:
    """Facets by column (None: all; an empty set: none; a null value is in no set), a window of first bins, a text."""

    sets: dict[str, Sequence | None] = field(default_factory=dict)
    window: tuple[int, int] | None = None
    text: str | None = None
    #: Columns whose lower-cased values, joined by spaces, are searched.
    searched: tuple[str, ...] = ()
    ordinal: str = "ord_start"

    def masks(self) -> dict[str, Column]:
        """A never-null condition for each facet, the window and the text."""
        out = {}
        for column, wanted in self.sets.items():
            if wanted is not None:
                out[column] = F.coalesce(F.col(column).isin(list(wanted)), F.lit(False)) if wanted else F.lit(False)
        if self.window is not None:
            out["window"] = F.coalesce(F.col(self.ordinal).between(*self.window), F.lit(False))
        if self.text:
            hay = F.lower(F.concat_ws(" ", *self.searched))
            out["text"] = hay.contains(self.text.lower())
        return out

    def toggled(self, column: str, value, domain: Sequence) -> Request:
        """With a value of a facet switched; switching on the last one that was off asks for all."""
        now = set(domain) if self.sets.get(column) is None else set(self.sets[column] or ())
        now ^= {value}
        return Request({**self.sets, column: None if now == set(domain) else sorted(now)}, self.window, self.text, self.searched, self.ordinal)


def _all(masks: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, masks, F.lit(True))


def selected(records: DataFrame, request: Request) -> DataFrame:
    return records.filter(_all(list(request.masks().values())))


def facet_counts(records: DataFrame, request: Request, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n): how many records each value would give under all conditions but the facet's own.

    Written as one pass: each record carries all conditions once and counts
    for those facets whose other conditions it meets.
    """
    masks = request.masks()
    entries = [F.when(_all([m for k, m in masks.items() if k != c]) & F.col(c).isNotNull(), F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))) for c in columns]
    rows = records.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
    return rows.groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


def pooled(records: DataFrame, column: str, least: int, other: str) -> DataFrame:
    """records with values of a column that fewer than `least` have as one."""
    often = records.groupBy(column).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(F.col(column).alias("_often"))
    joined = records.join(often, records[column] == often["_often"], "left")
    return joined.withColumn(column, F.when(F.col("_often").isNull() & F.col(column).isNotNull(), F.lit(other)).otherwise(F.col(column))).drop("_often")
