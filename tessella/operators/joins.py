"""Joins of facts with dimensions: many to one, keys checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import Kind, kind_of
from ..plans.binder import is_unique


class JoinError(ValueError):
    """Keys of the wrong kind or not unique, or column names that clash."""


def dimension_join(facts: DataFrame, dims: DataFrame, on: Sequence[tuple[str, str]], how: str = "left", columns: Sequence[str] | None = None) -> DataFrame:
    """All columns of facts, and some of dims, without its keys. A left join adds ``matched``, 1 or 0.

    NULL keys match nothing. Spark broadcasts dims if its size allows, else both sides meet by key, where
    adaptive execution splits keys that hold very many rows.
    """
    for a, b in on:
        x, y = kind_of(facts.schema[a].dataType), kind_of(dims.schema[b].dataType)
        if x is not y or x in (Kind.FLOAT, Kind.BOOL):
            raise JoinError(f"cannot join '{a}' ({x.value}) with '{b}' ({y.value})")
    keys = [b for _, b in on]
    extra = [c for c in (columns or dims.columns) if c not in keys]
    clash = sorted(set(extra + (["matched"] if how == "left" else [])) & set(facts.columns))
    if clash:
        raise JoinError(f"columns on both sides: {', '.join(clash)}")
    if not is_unique(dims, keys):
        raise JoinError(f"the key is not unique: {', '.join(keys)}")
    right = dims.select(*(F.col(b).alias(f"__k{i}") for i, b in enumerate(keys)), *extra, F.lit(1).alias("__hit"))
    equal = [facts[a] == F.col(f"__k{i}") for i, (a, _) in enumerate(on)]
    out = facts.join(right, equal, how).drop(*(f"__k{i}" for i in range(len(keys))))
    return out.withColumn("matched", F.coalesce("__hit", F.lit(0))).drop("__hit") if how == "left" else out.drop("__hit")
