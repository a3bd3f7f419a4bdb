"""Kinds of values, and columns that know theirs."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kind(Enum):
    INT = "int"
    FLOAT = "float"
    TEXT = "text"
    BOOL = "bool"
    DATE = "date"
    TIMESTAMP = "timestamp"
    NULL = "null"

    @property
    def numeric(self) -> bool:
        """Numbers, and what counts as one: days and milliseconds since 1970."""
        return self in (Kind.INT, Kind.FLOAT, Kind.DATE, Kind.TIMESTAMP, Kind.NULL)

    @property
    def temporal(self) -> bool:
        return self in (Kind.DATE, Kind.TIMESTAMP)

    def goes_to(self, other: Kind) -> bool:
        """Whether a value of this kind may stand where the other is asked for."""
        return self is other or self is Kind.NULL or other is Kind.FLOAT and self.numeric or other is Kind.INT and self.temporal


SPARK = {Kind.INT: "bigint", Kind.FLOAT: "double", Kind.TEXT: "string", Kind.BOOL: "boolean", Kind.DATE: "date", Kind.TIMESTAMP: "timestamp_ntz", Kind.NULL: "void"}


def kind_of(data_type: T.DataType) -> Kind:
    """The kind of a Spark type; nested and binary ones have none."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kind.INT
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Kind.FLOAT
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return Kind.TEXT
    if isinstance(data_type, T.BooleanType):
        return Kind.BOOL
    if isinstance(data_type, T.DateType):
        return Kind.DATE
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType)):
        return Kind.TIMESTAMP
    if isinstance(data_type, T.NullType):
        return Kind.NULL
    raise TypeError(f"columns of type {data_type.simpleString()} are not supported")


@dataclass(frozen=True)
class Typed:
    """A column and its kind; value is that of a literal."""

    col: Column
    kind: Kind
    value: Any = None

    def to(self, kind: Kind) -> Column:
        """The column as another kind that it goes to."""
        if self.kind is kind:
            return self.col
        if self.kind is Kind.NULL:
            return F.lit(None).cast(SPARK[kind])
        whole = self.col if self.kind in (Kind.INT, Kind.FLOAT) else number(self)
        return whole.cast(SPARK[kind])


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def number(x: Typed) -> Column:
    """Days of a date, milliseconds of a timestamp, 0 or 1 of a boolean; numbers as they are."""
    if x.kind is Kind.DATE:
        return F.unix_date(x.col).cast("long")
    if x.kind is Kind.TIMESTAMP:
        return F.timestamp_diff("MILLISECOND", epoch(), x.col)
    if x.kind is Kind.BOOL:
        return x.col.cast("long")
    return x.col


def common(kinds: list[Kind]) -> Kind | None:
    """The kind that all go to: one of theirs, or FLOAT for numbers; None if there is none."""
    known = [k for k in kinds if k is not Kind.NULL]
    if not known:
        return Kind.NULL
    if all(k is known[0] for k in known):
        return known[0]
    if all(k.numeric for k in known) and len({k for k in known if k.temporal}) < 2:
        return Kind.FLOAT if Kind.FLOAT in known else Kind.INT
    return None


def literal(value: Any) -> Typed:
    """A Python value as a column; whole numbers are INT."""
    if value is None:
        return Typed(F.lit(None), Kind.NULL)
    if isinstance(value, bool):
        return Typed(F.lit(value), Kind.BOOL, value)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long"), Kind.INT, value)
    if isinstance(value, float):
        return Typed(F.lit(value).cast("double"), Kind.FLOAT, value)
    return Typed(F.lit(value), Kind.TEXT, value)
