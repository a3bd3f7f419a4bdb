"""Ready-made functions beyond the built-in ones: patterns, JSON, zones, dates, addresses, distances.

JVM expressions but for ``unaccent``, which runs over Arrow batches. Names of countries and marks of numbers are the JVM's.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .kinds import Kind, Typed
from .registry import DAY, NUMBER, TEXT, TIME, Function


def _flags(flags: Typed | None) -> str:
    """JavaScript's flags as an inline group; g and u change nothing here."""
    kept = "".join(c for c in str(flags.value or "") if c in "ims") if flags is not None else ""
    return f"(?{kept})" if kept else ""


def _pattern(p: Typed, flags: Typed | None = None) -> Column:
    return F.concat(F.lit(_flags(flags)), p.to(Kind.TEXT)) if p.value is None else F.lit(_flags(flags) + p.value)


def regexp(s: Typed, pattern: Typed, flags: Typed | None = None) -> Typed:
    return Typed(F.regexp_like(s.to(Kind.TEXT), _pattern(pattern, flags)), Kind.BOOL)


def regexp_extract(s: Typed, pattern: Typed, group: Typed | None = None) -> Typed:
    """A group by number or name, else the whole match; NULL if nothing matches."""
    p, text = _pattern(pattern), s.to(Kind.TEXT)
    which = 0 if group is None else group.value
    if isinstance(which, str):
        names = re.findall(r"\(\?<([A-Za-z][A-Za-z0-9]*)>|(\((?!\?))", pattern.value or "")
        order = [n for n, _ in names]
        if which not in order:
            raise ValueError(f"the pattern has no group '{which}'")
        which = order.index(which) + 1
    return Typed(F.when(F.regexp_like(text, p), F.call_function("regexp_extract", text, p, F.lit(int(which)))), Kind.TEXT)


def regexp_replace(s: Typed, pattern: Typed, new: Typed, flags: Typed | None = None) -> Typed:
    """All matches; $1 and $<name> stand for groups."""
    by = F.regexp_replace(new.to(Kind.TEXT), r"\$<([A-Za-z][A-Za-z0-9]*)>", r"\$\{$1\}") if new.value is None else F.lit(re.sub(r"\$<([A-Za-z][A-Za-z0-9]*)>", r"${\1}", new.value))
    return Typed(F.regexp_replace(s.to(Kind.TEXT), _pattern(pattern, flags), by), Kind.TEXT)


def json_extract(doc: Typed, path: Typed) -> Typed:
    return Typed(F.call_function("get_json_object", doc.to(Kind.TEXT), path.to(Kind.TEXT)), Kind.TEXT)


def to_tz(ts: Typed, zone: Typed) -> Typed:
    """A UTC time as text in a zone."""
    return Typed(F.date_format(F.convert_timezone(F.lit("UTC"), zone.to(Kind.TEXT), ts.col.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss"), Kind.TEXT)


def date_trunc(unit: Typed, ts: Typed) -> Typed:
    """year, quarter, month, week (from Monday), day or hour."""
    if unit.value not in ("year", "quarter", "month", "week", "day", "hour"):
        raise ValueError(f"unknown unit '{unit.value}'")
    at = ts.col.cast("timestamp_ntz")
    if unit.value == "hour":
        return Typed(F.timestamp_add("HOUR", F.hour(at), at.cast("date").cast("timestamp_ntz")), Kind.TIMESTAMP)
    return Typed((at.cast("date") if unit.value == "day" else F.trunc(at.cast("date"), unit.value)).cast("timestamp_ntz"), Kind.TIMESTAMP)


def date_add(d: Typed, n: Typed, unit: Typed) -> Typed:
    """day, week, month or year; the month's last day stands for days that it lacks."""
    whole = n.to(Kind.INT).cast("int")
    if unit.value not in ("day", "week", "month", "year"):
        raise ValueError(f"unknown unit '{unit.value}'")
    if d.kind is Kind.TIMESTAMP:
        return Typed(F.timestamp_add(unit.value.upper(), whole, d.col), Kind.TIMESTAMP)
    step = {"day": lambda: F.date_add(d.col, whole), "week": lambda: F.date_add(d.col, whole * 7), "month": lambda: F.add_months(d.col, whole), "year": lambda: F.add_months(d.col, whole * 12)}
    return Typed(step[unit.value](), Kind.DATE)


def weekday(d: Typed) -> Typed:
    return Typed(F.weekday(d.col).cast("long"), Kind.INT)


def quarter(d: Typed) -> Typed:
    return Typed(F.quarter(d.col).cast("long"), Kind.INT)


def _jvm():
    return SparkSession.active().sparkContext._jvm


@lru_cache(maxsize=64)
def _countries(locale: str) -> dict[str, str]:
    """Names of all ISO 3166 alpha-2 codes, as the JVM's locale data has them."""
    java = _jvm().java.util.Locale
    shown = java.forLanguageTag(locale)
    return {str(code): str(java("", code).getDisplayCountry(shown)) for code in java.getISOCountries()}


def country_name(code: Typed, locale: Typed | None = None) -> Typed:
    """The name in a locale (en unless given) of an ISO 3166 alpha-2 code in either case. Two letters that are no code come back as capitals; NULL for anything else."""
    names = _countries(str(locale.value) if locale is not None and locale.value is not None else "en")
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    key = F.upper(code.to(Kind.TEXT))
    return Typed(F.when(F.regexp_like(key, F.lit("^[A-Z]{2}$")), F.coalesce(F.try_element_at(table, key), key)), Kind.TEXT)


@dataclass(frozen=True)
class _Numbers:
    """How a locale writes numbers: its marks, and for compact ones (least, divisor, text before, text after)."""

    group: str
    point: str
    minus: str
    compact: tuple[tuple[float, float, str, str], ...]


@lru_cache(maxsize=64)
def _numbers(locale: str) -> _Numbers:
    java = _jvm().java
    shown = java.util.Locale.forLanguageTag(locale)
    symbols = java.text.DecimalFormatSymbols.getInstance(shown)
    short = java.text.NumberFormat.getCompactNumberInstance(shown, java.text.NumberFormat.Style.SHORT)
    compact = []
    for power in range(3, 15):
        before, digits, after = re.fullmatch(r"(\D*)(\d+)(.*)", str(short.format(float(10**power))), re.S).groups()
        if len(digits) <= 3:  # else the locale has no short form of this size
            compact.append((float(10**power), 10**power / int(digits), before, after))
    return _Numbers(str(symbols.getGroupingSeparator()), str(symbols.getDecimalSeparator()), str(symbols.getMinusSign()), tuple(compact))


def format_number(x: Typed, spec: Typed | None = None) -> Typed:
    """By a locale (en-US unless given): digits in groups of three, one decimal at most, half away from zero. ``:compact`` after the locale shortens as it does (1.2M)."""
    text = str(spec.value) if spec is not None and spec.value is not None else "en-US"
    locale, _, how = text.partition(":")
    if how not in ("", "compact"):
        raise ValueError(f"a number's style is compact or none, not '{how}'")
    marks = _numbers(locale)
    v = x.to(Kind.FLOAT)

    def shown(y: Column) -> Column:
        fixed = F.regexp_replace(F.format_number(F.round(y, 1), 1), r"\.0$", "")
        return F.translate(fixed, ",.-", marks.group + marks.point + marks.minus)

    if not how:
        return Typed(shown(v), Kind.TEXT)
    out = None
    # a number that rounds up to a size has that size
    for least, divisor, before, after in reversed(marks.compact):
        lower = max((d for k, d, *_ in marks.compact if k < least), default=1.0)
        part = F.concat(F.lit(before), shown(v / divisor), F.lit(after))
        fits = F.round(F.abs(v) / lower, 1) >= least / lower
        out = F.when(fits, part) if out is None else out.when(fits, part)
    return Typed(out.otherwise(shown(v)) if out is not None else shown(v), Kind.TEXT)


class _Unmarked(dict):
    """For each letter itself, for each combining mark nothing; filled as letters come."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.category(chr(code)).startswith("M") else code
        return self[code]


_UNMARKED = _Unmarked()


def unaccent(s: Typed) -> Typed:
    """Letters apart from their marks (NFD), then without any combining mark, of whatever script."""

    @F.pandas_udf("string")
    def stripped(x: pd.Series) -> pd.Series:
        return x.map(lambda t: unicodedata.normalize("NFD", t).translate(_UNMARKED), na_action="ignore")

    return Typed(stripped(s.to(Kind.TEXT)), Kind.TEXT)


def url_host(u: Typed) -> Typed:
    """NULL if it is no address."""
    return Typed(F.call_function("try_parse_url", u.to(Kind.TEXT), F.lit("HOST")), Kind.TEXT)


#: Mean radius of the earth in metres; a fixed value.
EARTH = 6_371_008.8


def geo_distance(lat1: Typed, lon1: Typed, lat2: Typed, lon2: Typed) -> Typed:
    """Great-circle metres, by the haversine."""
    a, b, c, d = (F.radians(x.to(Kind.FLOAT)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2.0) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2.0)
    return Typed(2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h))), Kind.FLOAT)


LIBRARY: dict[str, Function] = {
    name: Function(name, build, params, least, len(params))
    for name, build, params, least in (
        ("regexp", regexp, (TEXT, TEXT, TEXT), 2),
        ("regexp_extract", regexp_extract, (TEXT, TEXT, (Kind.INT, Kind.TEXT)), 2),
        ("regexp_replace", regexp_replace, (TEXT, TEXT, TEXT, TEXT), 3),
        ("json_extract", json_extract, (TEXT, TEXT), 2),
        ("to_tz", to_tz, (TIME, TEXT), 2),
        ("date_trunc", date_trunc, (TEXT, DAY), 2),
        ("date_add", date_add, (DAY, NUMBER, TEXT), 3),
        ("weekday", weekday, (DAY,), 1),
        ("quarter", quarter, (DAY,), 1),
        ("country_name", country_name, (TEXT, TEXT), 1),
        ("format_number", format_number, (NUMBER, TEXT), 1),
        ("unaccent", unaccent, (TEXT,), 1),
        ("url_host", url_host, (TEXT,), 1),
        ("geo_distance", geo_distance, (NUMBER,) * 4, 4),
    )
}
