"""Frames whose columns have names of the dialect: case-sensitive, with any characters, and tied to a table."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import Kind, Typed, kind_of

_numbers = itertools.count()


def fresh() -> str:
    """A column name that no other frame has, so that joins never clash."""
    return f"c{next(_numbers)}"


@dataclass(frozen=True)
class Field:
    name: str
    inner: str
    kind: Kind
    table: str = ""
    own: str = ""
    hidden: bool = False

    def typed(self) -> Typed:
        return Typed(F.col(self.inner), self.kind)


@dataclass(frozen=True)
class Relation:
    """key: text that names the contents; equal keys mean equal rows."""

    df: DataFrame
    fields: tuple[Field, ...]
    key: str

    @classmethod
    def of(cls, df: DataFrame, key: str, table: str = "") -> Relation:
        """Whole numbers become 64-bit, floats and decimals doubles, timestamps lose their zone; nested columns are refused."""
        fields, columns = [], []
        for i, f in enumerate(df.schema.fields):
            kind = kind_of(f.dataType)
            inner = fresh()
            column = F.col(f"`{f.name.replace('`', '``')}`") if df.columns.count(f.name) == 1 else None
            if column is None:
                raise ValueError(f"two columns are named '{f.name}'")
            want = {Kind.INT: "bigint", Kind.FLOAT: "double", Kind.TEXT: "string", Kind.TIMESTAMP: "timestamp_ntz"}.get(kind)
            columns.append((column.cast(want) if want and f.dataType.simpleString() != want else column).alias(inner))
            fields.append(Field(f.name, inner, kind, table, f.name))
        return cls(df.select(columns), tuple(fields), key)

    def named(self, table: str) -> Relation:
        """The same rows under a table name, with columns of their own, so that a table can meet itself in a join."""
        names = {f.inner: fresh() for f in self.fields}
        df = self.df.select([F.col(old).alias(new) for old, new in names.items()])
        return replace(self, df=df, fields=tuple(replace(f, inner=names[f.inner], table=table, own=f.name) for f in self.fields if not f.hidden))

    def find(self, name: str, table: str | None = None) -> Field | None:
        for f in self.fields:
            if (f.name == name and not f.hidden) if table is None else (f.table == table and f.own == name):
                return f
        if table is None:
            return next((f for f in self.fields if f.name == name), None)
        return None

    def tables(self) -> set[str]:
        return {f.table for f in self.fields}

    def visible(self) -> list[Field]:
        return [f for f in self.fields if not f.hidden]

    def output(self) -> DataFrame:
        return self.df.select([F.col(f.inner).alias(f.name) for f in self.visible()])
