"""User-defined functions with typed signatures, over Arrow batches or value by value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import functions as F

from ..plans.diagnostics import Span, SqlError
from .kinds import SPARK, Kind, Typed
from .registry import FUNCTIONS, INTERNAL, Function

KINDS = {"int": Kind.INT, "float": Kind.FLOAT, "bool": Kind.BOOL, "text": Kind.TEXT, "date": Kind.DATE, "timestamp": Kind.TIMESTAMP}


@dataclass(frozen=True)
class UserFunction:
    """params: kinds by name, or ``any``. optional counts the last parameters that may be left out; variadic repeats the last.

    strict: rows with a NULL argument give NULL without a call.
    """

    name: str
    fn: Callable[..., Any]
    params: tuple[str, ...]
    returns: str
    strict: bool = True
    variadic: bool = False
    optional: int = 0
    per_row: bool = False
    serial: int = 0

    def __post_init__(self) -> None:
        if self.name in FUNCTIONS or self.name in INTERNAL:
            raise ValueError(f"'{self.name}' is a built-in function")
        for p in (*self.params, self.returns):
            if p not in KINDS and (p != "any" or p is self.returns):
                raise ValueError(f"unknown kind '{p}'")

    def bind(self, args: list[Typed], spans: list[Span], span: Span) -> Typed:
        least, n = len(self.params) - self.optional, len(args)
        if self.variadic:
            least = min(least, len(self.params))
        if n < least or (n > len(self.params) and not self.variadic):
            shown = f"{least} or more" if self.variadic else str(least) if not self.optional else f"{least} to {len(self.params)}"
            raise SqlError(f"{self.name}() takes {shown} argument(s), got {n}", span)
        kind = KINDS[self.returns]
        columns = []
        for i, (arg, where) in enumerate(zip(args, spans, strict=True)):
            want = self.params[min(i, len(self.params) - 1)]
            if want != "any" and not arg.kind.goes_to(KINDS[want]):
                raise SqlError(f"{self.name}() needs {want}, this is {arg.kind.value}", where)
            if self.strict and arg.kind is Kind.NULL:
                return Typed(F.lit(None).cast(SPARK[kind]), kind)
            columns.append(arg.to(KINDS[want]) if want != "any" else arg.col if arg.kind is not Kind.NULL else arg.col.cast("string"))
        return Typed(self._call()(*(columns or [F.lit(True)])), kind)

    def _call(self):
        fn, strict, spark_type, bare = self.fn, self.strict, SPARK[KINDS[self.returns]], not self.params
        if self.per_row:

            def row(*values):
                if bare:
                    return fn()
                return None if strict and any(v is None for v in values) else fn(*values)

            return F.udf(row, spark_type, useArrow=True)

        @F.pandas_udf(spark_type)
        def batch(*series: pd.Series) -> pd.Series:
            if bare:
                return pd.Series([fn()] * len(series[0]))
            if not strict:
                return pd.Series(fn(*series), index=series[0].index)
            full = pd.concat([s.notna() for s in series], axis=1).all(axis=1)
            out = pd.Series([None] * len(full), index=full.index, dtype=object)
            if full.any():
                out[full] = pd.Series(fn(*(s[full] for s in series)), index=full.index[full]).astype(object)
            return out

        return batch


@dataclass(frozen=True)
class LibraryFunction:
    """A ready-made function, checked as built-in ones are, but with a name that a user's may take."""

    function: Function

    def bind(self, args: list[Typed], spans: list[Span], span: Span) -> Typed:
        f = self.function
        if not f.least <= len(args) <= f.most:
            raise SqlError(f"{f.name}() takes {f.arity} argument(s), got {len(args)}", span)
        for i, (arg, where) in enumerate(zip(args, spans, strict=True)):
            if arg.kind is not Kind.NULL and arg.kind not in f.param(i):
                raise SqlError(f"{f.name}() needs {f.param(i)[0].value}, this is {arg.kind.value}", where)
        try:
            return f.build(*args)
        except ValueError as e:
            raise SqlError(f"{f.name}(): {e}", span) from None
