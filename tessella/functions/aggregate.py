"""Builders of the aggregate functions. Partial aggregation before the shuffle is Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import Kind, Typed
from .scalar import to_text

#: Column with each row's place, added only for queries that need it.
POSITION = "__pos"


def count_all() -> Typed:
    return Typed(F.count(F.lit(1)), Kind.INT)


def count(x: Typed) -> Typed:
    return Typed(F.count(x.col), Kind.INT)


def count_distinct(x: Typed) -> Typed:
    return Typed(F.count_distinct(x.col) if x.kind is not Kind.NULL else F.count(x.col), Kind.INT)


def total(x: Typed) -> Typed:
    """NULL without values; a sum of whole numbers that overflows is NULL too."""
    if x.kind is Kind.FLOAT:
        return Typed(F.sum(x.col), Kind.FLOAT)
    return Typed(F.try_sum(x.to(Kind.INT)), Kind.INT)


def average(x: Typed) -> Typed:
    return Typed(F.avg(x.to(Kind.FLOAT)), Kind.FLOAT)


def least(x: Typed) -> Typed:
    return Typed(F.min(x.col), x.kind)


def greatest(x: Typed) -> Typed:
    return Typed(F.max(x.col), x.kind)


def median(x: Typed) -> Typed:
    """Exact; of an even number of values the mean of the middle two. Spark holds one count per distinct value of a group."""
    return Typed(F.median(x.to(Kind.FLOAT)), Kind.FLOAT)


def deviation(x: Typed) -> Typed:
    """Of a sample: NULL for fewer than two values."""
    return Typed(F.stddev_samp(x.to(Kind.FLOAT)), Kind.FLOAT)


def group_concat(x: Typed, separator: Typed | None = None, position: Column | None = None) -> Typed:
    """Texts of the values in row order, NULLs left out; NULL if there are none."""
    sep = "," if separator is None else str(separator.value)
    text = to_text(x).col
    items = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct((F.col(POSITION) if position is None else position).alias("at"), text.alias("text")))))
    return Typed(F.when(F.count(text) > 0, F.array_join(F.transform(items, lambda i: i["text"]), sep)), Kind.TEXT)
