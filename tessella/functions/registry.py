"""The built-in functions by name: parameters, result and builder.

A parameter is a tuple of the kinds it takes; ``ANY`` takes all. Checks happen before any column
is built, so that errors can point at the argument.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from . import aggregate as A
from . import scalar as S
from .kinds import Kind, Typed

ANY = tuple(Kind)
NUMBER = (Kind.INT, Kind.FLOAT, Kind.DATE, Kind.TIMESTAMP)
TEXT = (Kind.TEXT,)
BOOL = (Kind.BOOL,)
DAY = (Kind.DATE, Kind.TIMESTAMP)
TIME = (Kind.TIMESTAMP,)
MOMENT = (Kind.TEXT, Kind.INT, Kind.DATE, Kind.TIMESTAMP)


@dataclass(frozen=True)
class Function:
    name: str
    build: Callable[..., Typed]
    params: tuple[tuple[Kind, ...], ...]
    least: int
    most: int | None
    aggregate: bool = False
    alike: bool = False  # all arguments must have a common kind

    def param(self, i: int) -> tuple[Kind, ...]:
        return self.params[min(i, len(self.params) - 1)] if self.params else ANY

    @property
    def arity(self) -> str:
        if self.most is None:
            return f"{self.least} or more"
        return str(self.least) if self.least == self.most else f"{self.least} to {self.most}"


def _entries() -> dict[str, Function]:
    out: dict[str, Function] = {}

    def add(name, build, *params, least=None, most=-1, aggregate=False, alike=False):
        n = len(params)
        out[name] = Function(name, build, params, n if least is None else least, n if most == -1 else most, aggregate, alike)

    for name, build in (("count", A.count), ("count_distinct", A.count_distinct), ("min", A.least), ("max", A.greatest)):
        add(name, build, ANY, aggregate=True)
    for name, build in (("sum", A.total), ("avg", A.average), ("median", A.median), ("stddev", A.deviation)):
        add(name, build, NUMBER, aggregate=True)
    add("group_concat", A.group_concat, ANY, TEXT, least=1, aggregate=True)

    for name in ("floor", "ceil", "sqrt", "exp", "ln", "sign"):
        add(name, getattr(S, name), NUMBER)
    add("abs", S.absolute, NUMBER)
    add("round", S.rounded, NUMBER, NUMBER, least=1)
    for name in ("pow", "power"):
        add(name, S.power, NUMBER, NUMBER)

    for name in ("lower", "upper", "length"):
        add(name, getattr(S, name), TEXT)
    add("substr", S.substr, TEXT, NUMBER, NUMBER, least=2)
    add("concat", S.concat, TEXT, ANY, most=None)
    for name in ("trim", "ltrim", "rtrim"):
        add(name, getattr(S, name), TEXT, TEXT, least=1)
    add("replace", S.replace, TEXT, TEXT, TEXT)
    add("instr", S.instr, TEXT, TEXT)

    add("coalesce", S.coalesce, ANY, ANY, most=None)
    add("ifnull", S.coalesce, ANY, ANY)
    add("nullif", S.nullif, ANY, ANY)
    add("isnull", S.is_null, ANY)
    add("if", S.case, BOOL, ANY, ANY)
    add("case", S.case, BOOL, ANY, least=2, most=None)

    for name in ("year", "month", "day"):
        add(name, getattr(S, name), DAY)
    for name in ("hour", "minute", "second"):
        add(name, getattr(S, name), TIME)
    add("date", S.date, MOMENT)
    add("timestamp", S.timestamp, MOMENT)
    add("strftime", S.strftime, TEXT, DAY)

    add("between", S.between, ANY, ANY, ANY, alike=True)
    add("in", S.is_in, ANY, ANY, most=None, alike=True)
    add("like", S.like, TEXT, TEXT)
    add("int", S.to_int, ANY)
    add("float", S.to_float, ANY)
    add("text", S.to_text, ANY)
    return out


FUNCTIONS = _entries()
#: Names that only the rewriting of subqueries uses.
INTERNAL = ("in_set", "exists_set")
AGGREGATES = frozenset(f.name for f in FUNCTIONS.values() if f.aggregate)
