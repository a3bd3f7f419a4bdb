"""Builders of the built-in scalar functions: typed columns in, a typed column out.

All are JVM expressions. Session settings stay as they are: where ANSI mode would raise, guards
give NULL, as the dialect asks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import SPARK, Kind, Typed, common, epoch, number

#: Characters whose lower case is ASCII though they are not; LIKE tells them from it. Fixed values.
KELVIN, DOTTED_I = "\u212a", "\u0130"
_PRIVATE = "\ue000\ue001"


def _null(kind: Kind) -> Column:
    return F.lit(None).cast(SPARK[kind])


def _no_nan(x: Column) -> Typed:
    return Typed(F.when(~F.isnan(x), x), Kind.FLOAT)


def _double(x: Typed) -> Column:
    return x.to(Kind.FLOAT)


# arithmetic


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    """+ - * / %; whole numbers stay whole, division by zero and overflow of whole numbers give NULL."""
    if Kind.FLOAT in (a.kind, b.kind):
        x, y = _double(a), _double(b)
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / F.nullif(y, F.lit(0.0)), "%": lambda: x % F.nullif(y, F.lit(0.0))}
        return Typed(out[op](), Kind.FLOAT)
    x, y = a.to(Kind.INT), b.to(Kind.INT)
    zero = F.lit(0).cast("long")
    if op == "/":
        return Typed(F.when(y == -1, F.try_subtract(zero, x)).otherwise(F.call_function("div", x, F.nullif(y, zero))), Kind.INT)
    out = {"+": lambda: F.try_add(x, y), "-": lambda: F.try_subtract(x, y), "*": lambda: F.try_multiply(x, y), "%": lambda: x % F.nullif(y, zero)}
    return Typed(out[op](), Kind.INT)


def negative(a: Typed) -> Typed:
    return arithmetic("-", Typed(F.lit(0).cast("long"), Kind.INT), a) if a.kind is not Kind.FLOAT else Typed(-a.col, Kind.FLOAT)


def compare(op: str, a: Typed, b: Typed) -> Typed:
    kind = common([a.kind, b.kind]) or a.kind
    x, y = (a.col, b.col) if kind is Kind.NULL else (a.to(kind), b.to(kind))
    out = {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}
    return Typed(out[op](), Kind.BOOL)


def between(x: Typed, low: Typed, high: Typed) -> Typed:
    return Typed(compare(">=", x, low).col & compare("<=", x, high).col, Kind.BOOL)


def is_in(x: Typed, *options: Typed) -> Typed:
    kind = common([x.kind, *(o.kind for o in options)])
    if kind is None or kind is Kind.NULL:
        return Typed(_null(Kind.BOOL), Kind.BOOL)
    return Typed(x.to(kind).isin(*(o.to(kind) for o in options)), Kind.BOOL)


def like(text: Typed, pattern: Typed) -> Typed:
    """% and _, without regard to case, but no character beyond ASCII counts as one of it; a backslash is itself."""
    folded = F.translate(text.to(Kind.TEXT), KELVIN + DOTTED_I, _PRIVATE)
    if isinstance(pattern.value, str):
        p = pattern.value.translate(str.maketrans(KELVIN + DOTTED_I, _PRIVATE)).replace("\\", "\\\\")
        return Typed(folded.ilike(p), Kind.BOOL)
    p = F.replace(F.translate(pattern.to(Kind.TEXT), KELVIN + DOTTED_I, _PRIVATE), F.lit("\\"), F.lit("\\\\"))
    return Typed(F.ilike(folded, p), Kind.BOOL)


def is_null(x: Typed) -> Typed:
    return Typed(x.col.isNull(), Kind.BOOL)


def case(*args: Typed) -> Typed:
    """condition, value pairs and maybe a last value; the result's kind is the one that all values go to."""
    values = [*args[1::2], *(args[-1:] if len(args) % 2 else [])]
    kind = common([v.kind for v in values]) or values[0].kind
    give = (lambda v: v.col) if kind is Kind.NULL else (lambda v: v.to(kind))
    out = None
    for condition, value in zip(args[0::2], args[1::2], strict=False):
        test = condition.to(Kind.BOOL)
        out = F.when(test, give(value)) if out is None else out.when(test, give(value))
    return Typed(out.otherwise(give(args[-1])) if len(args) % 2 else out, kind)


def coalesce(*args: Typed) -> Typed:
    kind = common([a.kind for a in args]) or args[0].kind
    return Typed(F.coalesce(*(a.col if kind is Kind.NULL else a.to(kind) for a in args)), kind)


def nullif(a: Typed, b: Typed) -> Typed:
    return Typed(F.when(~F.coalesce(compare("=", a, b).col, F.lit(False)), a.col), a.kind)


# numbers


def absolute(x: Typed) -> Typed:
    return Typed(F.abs(x.col), Kind.FLOAT) if x.kind is Kind.FLOAT else Typed(F.abs(x.to(Kind.INT)), Kind.INT)


def rounded(x: Typed, digits: Typed | None = None) -> Typed:
    """Half away from zero, of x times the power of ten; whole numbers stay whole."""
    if x.kind is not Kind.FLOAT:
        whole = x.to(Kind.INT)
        if digits is None:
            return Typed(whole, Kind.INT)
        scale = F.pow(F.lit(10.0), digits.to(Kind.FLOAT))
        return Typed(F.when(digits.to(Kind.INT) >= 0, whole).otherwise((F.round(whole * scale) / scale).cast("long")), Kind.INT)
    if digits is None:
        return Typed(F.round(x.col), Kind.FLOAT)
    if isinstance(digits.value, int) and 0 <= digits.value <= 15:
        scale = F.lit(10.0**digits.value)
    else:
        scale = F.pow(F.lit(10.0), digits.to(Kind.FLOAT))
    return Typed(F.round(x.col * scale) / scale, Kind.FLOAT)


def _whole_part(f):
    def build(x: Typed) -> Typed:
        if x.kind is not Kind.FLOAT:
            return Typed(x.to(Kind.INT), Kind.INT)
        return Typed(F.when(F.abs(x.col) < 1e15, f(x.col).cast("double")).otherwise(x.col), Kind.FLOAT)

    return build


floor, ceil = _whole_part(F.floor), _whole_part(F.ceil)


def sign(x: Typed) -> Typed:
    return Typed(F.signum(x.to(Kind.FLOAT)).cast("long"), Kind.INT)


def sqrt(x: Typed) -> Typed:
    return _no_nan(F.sqrt(_double(x)))


def exp(x: Typed) -> Typed:
    return _no_nan(F.exp(_double(x)))


def ln(x: Typed) -> Typed:
    v = _double(x)
    return _no_nan(F.when(v > 0, F.ln(v)))


def power(x: Typed, y: Typed) -> Typed:
    return _no_nan(F.pow(_double(x), _double(y)))


# texts


def _of_text(f, kind: Kind = Kind.TEXT):
    return lambda s, *rest: Typed(f(s.to(Kind.TEXT), *rest), kind)


lower, upper = _of_text(F.lower), _of_text(F.upper)
length = _of_text(lambda s: F.char_length(s).cast("long"), Kind.INT)


def substr(s: Typed, start: Typed, size: Typed | None = None) -> Typed:
    """From 1; 0 counts as 1, and a negative start counts from the end."""
    at = start.to(Kind.INT).cast("int")
    at = F.when(at == 0, F.lit(1)).otherwise(at)
    most = F.lit(2**31 - 1) if size is None else F.greatest(size.to(Kind.INT).cast("int"), F.lit(0))
    text = s.to(Kind.TEXT)
    if size is not None and size.kind is not Kind.NULL:
        return Typed(F.when(size.col.isNotNull(), F.substring(text, at, most)), Kind.TEXT)
    return Typed(F.substring(text, at, most), Kind.TEXT)


def concat(*args: Typed) -> Typed:
    return Typed(F.concat(*(to_text(a, booleans=("true", "false")).col for a in args)), Kind.TEXT)


def _trimmed(how: str):
    plain = {"BOTH": F.trim, "LEADING": F.ltrim, "TRAILING": F.rtrim}[how]

    def build(s: Typed, chars: Typed | None = None) -> Typed:
        if chars is None:
            return Typed(plain(s.to(Kind.TEXT)), Kind.TEXT)
        return Typed(plain(s.to(Kind.TEXT), chars.to(Kind.TEXT)), Kind.TEXT)

    return build


trim, ltrim, rtrim = _trimmed("BOTH"), _trimmed("LEADING"), _trimmed("TRAILING")


def replace(s: Typed, old: Typed, new: Typed) -> Typed:
    text, a = s.to(Kind.TEXT), old.to(Kind.TEXT)
    return Typed(F.when(a == "", F.when(new.to(Kind.TEXT).isNotNull(), text)).otherwise(F.replace(text, a, new.to(Kind.TEXT))), Kind.TEXT)


def instr(s: Typed, part: Typed) -> Typed:
    return Typed(F.locate(part.value, s.to(Kind.TEXT)).cast("long") if isinstance(part.value, str) else F.call_function("instr", s.to(Kind.TEXT), part.to(Kind.TEXT)).cast("long"), Kind.INT)


def to_int(x: Typed) -> Typed:
    """Texts by strict whole-number form, else NULL; floats lose their fraction."""
    if x.kind is Kind.TEXT:
        s = F.trim(x.col)
        return Typed(F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint")), Kind.INT)
    if x.kind is Kind.FLOAT:
        return Typed(F.when(~F.isnan(x.col), x.col.try_cast("bigint")).otherwise(F.when(x.col.isNotNull(), F.lit(0).cast("long"))), Kind.INT)
    return Typed(_null(Kind.INT) if x.kind is Kind.NULL else number(x), Kind.INT)


def to_float(x: Typed) -> Typed:
    if x.kind is Kind.TEXT:
        s = F.trim(x.col)
        return Typed(F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double")), Kind.FLOAT)
    return Typed(_null(Kind.FLOAT) if x.kind is Kind.NULL else number(x).cast("double"), Kind.FLOAT)


def float_text(x: Column) -> Column:
    """The shortest digits without exponent; whole values without a fraction."""
    plain = x.cast("string")
    fixed = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("decimal(38,0)").cast("string")).when(plain.contains("E") & (F.abs(x) < 1e18), fixed).otherwise(plain)


def to_text(x: Typed, booleans: tuple[str, str] = ("1", "0")) -> Typed:
    if x.kind is Kind.FLOAT:
        return Typed(float_text(x.col), Kind.TEXT)
    if x.kind is Kind.BOOL:
        return Typed(F.when(x.col, booleans[0]).when(~x.col, booleans[1]), Kind.TEXT)
    if x.kind is Kind.TIMESTAMP:
        return Typed(F.regexp_replace(F.date_format(x.col, "yyyy-MM-dd HH:mm:ss.SSS"), r"\.000$", ""), Kind.TEXT)
    return Typed(_null(Kind.TEXT) if x.kind is Kind.NULL else x.col.cast("string"), Kind.TEXT)


# dates


def _field(f):
    return lambda x: Typed(_null(Kind.INT) if x.kind is Kind.NULL else f(x.col).cast("long"), Kind.INT)


year, month, day = _field(F.year), _field(F.month), _field(F.day)
hour, minute, second = _field(F.hour), _field(F.minute), _field(F.second)


def date(x: Typed) -> Typed:
    if x.kind is Kind.TEXT:
        return Typed(F.when(x.col.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x.col, "yyyy-MM-dd")), Kind.DATE)
    if x.kind in (Kind.INT, Kind.FLOAT):
        return Typed(F.date_from_unix_date(number(x).try_cast("int")), Kind.DATE)
    return Typed(x.col.cast("date"), Kind.DATE)


def timestamp(x: Typed) -> Typed:
    if x.kind is Kind.TEXT:
        return Typed(F.when(x.col.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,3})?)?$"), x.col.try_cast("timestamp_ntz")), Kind.TIMESTAMP)
    if x.kind in (Kind.INT, Kind.FLOAT):
        return Typed(F.timestamp_add("MILLISECOND", number(x).cast("long"), epoch()), Kind.TIMESTAMP)
    return Typed(x.col.cast("timestamp_ntz"), Kind.TIMESTAMP)


#: strftime tokens and Spark's patterns for them; fixed values.
_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}


def strftime(fmt: Typed, x: Typed) -> Typed:
    """%Y %m %d %H %M %S %s %%; other tokens stay as they are. The format is a literal."""
    if not isinstance(fmt.value, str):
        raise ValueError("strftime() needs a literal format")
    at = x.col.cast("timestamp_ntz")
    parts: list[Column] = [F.lit("")]
    for piece in re.findall(r"%.|[^%]+|%$", fmt.value, re.S):
        if piece[0] == "%" and piece[1:] in _STRFTIME:
            parts.append(F.date_format(at, _STRFTIME[piece[1:]]))
        elif piece == "%s":
            parts.append(F.timestamp_diff("SECOND", epoch(), at).cast("string"))
        else:
            parts.append(F.lit("%" if piece == "%%" else piece))
    return Typed(F.when(at.isNotNull(), F.concat(*parts)), Kind.TEXT)
