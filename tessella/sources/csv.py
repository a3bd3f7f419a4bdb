"""CSV with sniffed types.

One pass counts, for each column and candidate type, the cells that do not fit; a second reads the
cells typed. Candidates in order: whole numbers, floats, ISO dates, ISO timestamps, else text.
Empty cells are NULL in typed columns and empty texts in text columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import Kind, Typed
from ..functions.scalar import date, timestamp, to_float, to_int

_CANDIDATES = ((Kind.INT, to_int), (Kind.FLOAT, to_float), (Kind.DATE, date), (Kind.TIMESTAMP, timestamp))


def read_text_csv(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """All cells as text, empty ones NULL. A row with too few or too many cells is an error.

    multiline: quoted cells may hold line ends, for which each file is read by one task. Without it
    files are split.
    """
    df = spark.read.options(header=True, quote='"', escape='"', multiLine=multiline, mode="FAILFAST", inferSchema=False).csv(path)
    df = df.toDF(*(c.removeprefix("\ufeff").rstrip("\r") for c in df.columns))
    last = df.columns[-1]  # where line ends differ, a carriage return may be left at the end
    return df.withColumn(last, F.nullif(F.regexp_replace(_cell(last), "\r$", ""), F.lit("")))


def _cell(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def sniff(df: DataFrame) -> dict[str, Kind]:
    """Each column's kind, from all its cells; a column without cells is text."""
    asked = []
    for i, name in enumerate(df.columns):
        cell = Typed(_cell(name), Kind.TEXT)
        full = cell.col.isNotNull()
        asked.append(F.count(F.when(full, 1)).alias(f"n{i}"))
        asked += [F.count(F.when(full & build(cell).col.isNull(), 1)).alias(f"{kind.value}{i}") for kind, build in _CANDIDATES]
    row = df.agg(*asked).first()
    return {name: next((k for k, _ in _CANDIDATES if row[f"n{i}"] and not row[f"{k.value}{i}"]), Kind.TEXT) for i, name in enumerate(df.columns)}


def read_csv(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    df = read_text_csv(spark, path, multiline)
    builders = dict(_CANDIDATES)
    columns = []
    for name, kind in sniff(df).items():
        cell = Typed(_cell(name), Kind.TEXT)
        columns.append((F.coalesce(cell.col, F.lit("")) if kind is Kind.TEXT else builders[kind](cell).col).alias(name))
    return df.select(columns)


def convert(spark: SparkSession, source: str, target: str, multiline: bool = True) -> None:
    """CSV to Parquet."""
    read_csv(spark, source, multiline).write.parquet(target)
