"""Facets: counts of each dimension's values under all filters except its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Facets:
    """counts: (dimension, value, count); totals: (pass_count, total) in one row; rows: those that pass all filters."""

    counts: DataFrame
    totals: DataFrame
    rows: DataFrame


def _member(column: Column, selected: Sequence[Any]) -> Column:
    """Whether a value is among those selected; none selected lets all pass, and None selects NULL."""
    if not selected:
        return F.lit(True)
    known = [v for v in selected if v is not None]
    hit = F.coalesce(column.isin(known), F.lit(False)) if known else F.lit(False)
    return hit | column.isNull() if None in selected else hit


def _one_pass(df: DataFrame, dims: Sequence[str], selected: Mapping[str, Sequence[Any]], measure: str | None) -> DataFrame:
    """(dimension, value, count, total): one scan. Totals stand under a null dimension.

    Rows are first summed up by the combination of their dimensions' values, on which alone it depends where a row counts, with partial
    sums before the shuffle. What is then dealt to the dimensions are combinations, which are few where dimensions are made for faceting.
    """
    passes = {d: _member(F.col(d), selected.get(d, ())) for d in dims}
    fails = sum((F.when(p, 0).otherwise(1) for p in passes.values()), F.lit(0))
    amount = (F.col(measure) if measure else F.lit(None)).cast("double")
    text = lambda c: c.cast("string")
    slim = df.select(*(text(F.col(d)).alias(f"v{i}") for i, d in enumerate(dims)), *(p.alias(f"p{i}") for i, p in enumerate(passes.values())), fails.alias("fails"), amount.alias("amount"))
    slim = slim.where("fails <= 1")  # a row that fails two filters counts nowhere
    combination = [f"{k}{i}" for k in "vp" for i in range(len(dims))]
    slim = slim.groupBy(*combination, "fails").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    none = F.lit(None).cast("string")
    # a row that passes all counts in every dimension and in the totals; one that fails one counts there only
    stands = [
        F.when((F.col("fails") == 0) | ~F.col(f"p{i}"), F.struct(F.lit(d).alias("dimension"), F.col(f"v{i}").alias("value"), F.col("n").alias("n"), F.lit(None).cast("double").alias("amount")))
        for i, d in enumerate(dims)
    ]
    stands.append(F.when(F.col("fails") == 0, F.struct(none.alias("dimension"), none.alias("value"), F.col("n").alias("n"), F.col("amount").alias("amount"))))
    each = slim.select(F.explode(F.filter(F.array(*stands), lambda s: s.isNotNull())).alias("s")).select("s.*")
    return each.groupBy("dimension", "value").agg(F.sum("n").alias("count"), F.sum("amount").alias("total"))


def facet_refresh(df: DataFrame, dims: Sequence[str], selected: Mapping[str, Sequence[Any]] | None = None, measure: str | None = None) -> Facets:
    """Counts for each dimension, and the number of rows and the measure's sum under all filters. NULL is a value of its own."""
    selected = selected or {}
    found = _one_pass(df, dims, selected, measure)
    counts = found.where(F.col("dimension").isNotNull()).select("dimension", "value", "count")
    totals = found.where(F.col("dimension").isNull()).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("pass_count"), F.sum("total").alias("total"))
    keep = F.lit(True)
    for d in dims:
        keep = keep & _member(F.col(d), selected.get(d, ()))
    return Facets(counts, totals, df.where(keep))


def sort_topk(df: DataFrame, by: str, k: int, position: str) -> DataFrame:
    """The k rows with the largest values, NULLs left out; ties go to the earlier place."""
    return df.where(F.col(by).isNotNull()).orderBy(F.col(by).desc(), F.col(position)).limit(k)


def with_position(df: DataFrame, name: str = "_pos") -> DataFrame:
    """Adds row numbers from 0 in file order. Only the number of rows of each partition comes to the driver."""
    part, local = "__part", "__local"
    marked = df.select("*", F.spark_partition_id().alias(part), (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias(local))
    sizes = sorted((r[part], r["n"]) for r in marked.groupBy(part).agg((F.max(local) + 1).alias("n")).collect())
    at, starts = 0, []
    for p, n in sizes:
        starts.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, f"{part} int, __start long")
    return marked.join(F.broadcast(offsets), part).withColumn(name, F.col(local) + F.col("__start")).drop(part, local, "__start")


def gather(df: DataFrame, indices: Sequence[int] | DataFrame, columns: Sequence[str], position: str = "_pos") -> DataFrame:
    """Columns of the rows at some places, in the order asked for. Places that do not exist are left out."""
    if isinstance(indices, DataFrame):
        wanted = indices.select(F.col(indices.columns[0]).cast("long").alias("__at"), F.col(indices.columns[1]).alias("__order"))
    else:
        wanted = df.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(indices)], "__at long, __order long")
    return df.join(wanted, df[position] == wanted["__at"]).orderBy("__order").select(*columns)
