"""Flat Parquet tables. Files are splittable and pruned by column and by row group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.kinds import kind_of


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A table without nested columns; those are refused by name."""
    df = spark.read.parquet(path)
    for f in df.schema.fields:
        try:
            kind_of(f.dataType)
        except TypeError as e:
            raise TypeError(f"column '{f.name}': {e}") from None
    return df


def write_parquet(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    """Sorted within files by some columns, if given, so that their statistics let readers skip row groups."""
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.parquet(path)
