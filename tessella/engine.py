"""The engine: tables by name, statements in the dialect, derived tables that are reused, user functions."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .functions.library import LIBRARY
from .functions.user import LibraryFunction, UserFunction
from .operators import batch
from .operators.describe import describe, files, is_clustered
from .plans.binder import Binder
from .plans.diagnostics import SqlError, suggestion
from .plans.relation import Relation
from .plans.syntax import Column, Literal, Query, parse
from .sources.csv import read_csv
from .sources.parquet import read_parquet

#: Most bytes of derived tables that are kept, by Spark's own estimate.
CACHE_BYTES = 64 << 20


@dataclass
class CacheStats:
    entries: int
    bytes: int
    hits: int
    misses: int
    evicted: int


class Derived:
    """Derived tables by what they are made of.

    A table that is asked for again, and that is estimated to fit the budget, is persisted; larger ones
    stay plans, into which Spark pushes the filters and columns of each use. The least recently used go first.
    """

    def __init__(self, budget: int):
        self.budget = budget
        self.seen: OrderedDict[str, Relation] = OrderedDict()
        self.kept: OrderedDict[str, tuple[DataFrame, int]] = OrderedDict()
        self.hits = self.misses = self.evicted = 0

    def get(self, key: str, build: Callable[[], Relation]) -> Relation:
        if key in self.seen:
            self.hits += 1
            self.seen.move_to_end(key)
            found = self.seen[key]
            if key in self.kept:
                self.kept.move_to_end(key)
            elif (size := estimate(found.df)) <= self.budget:
                found.df.persist(StorageLevel.MEMORY_AND_DISK)
                self.kept[key] = (found.df, size)
                self.shrink()
            return found
        self.misses += 1
        found = self.seen[key] = replace(build(), key=key)
        while len(self.seen) > 256:
            self.drop(next(iter(self.seen)))
        return found

    def drop(self, key: str) -> None:
        self.seen.pop(key, None)
        if key in self.kept:
            self.kept.pop(key)[0].unpersist()
            self.evicted += 1

    def shrink(self) -> None:
        while self.kept and sum(n for _, n in self.kept.values()) > self.budget:
            self.drop(next(iter(self.kept)))

    def clear(self) -> None:
        for key in list(self.seen):
            self.drop(key)


def estimate(df: DataFrame) -> int:
    """Spark's estimate of a frame's bytes after optimization."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Engine:
    """Statements name tables as they were loaded; any other name means the table given, or the last one loaded."""

    def __init__(self, spark: SparkSession, cache_bytes: int = CACHE_BYTES, library: bool = True):
        self.spark = spark
        self._tables: dict[str, Relation] = {}
        self._frames: dict[str, DataFrame] = {}
        self._loads = 0
        self._last: str | None = None
        self._functions: dict[str, UserFunction | LibraryFunction] = {n: LibraryFunction(f) for n, f in LIBRARY.items()} if library else {}
        self._derived = Derived(cache_bytes)
        self._unique: dict[str, bool] = {}
        self._sorted: dict[str, list[str]] = {}
        self._read: set[str] = set()

    # tables

    def load(self, name: str, df: DataFrame) -> DataFrame:
        """Registers a frame; a name that is taken is replaced, and what was derived from any table is worked out anew."""
        if name in self._tables:
            self._derived.clear()
        self._loads += 1
        self._tables[name] = Relation.of(df, f"{name}#{self._loads}")
        self._sorted.pop(name, None)
        self._read.discard(name)
        self._frames[name] = df
        self._last = name
        return df

    def load_parquet(self, name: str, path: str) -> DataFrame:
        df = self.load(name, read_parquet(self.spark, path))
        self._read.add(name)
        return df

    def load_csv(self, name: str, path: str | list[str], persist: str | None = None, multiline: bool = True) -> DataFrame:
        """CSV with sniffed types; persist writes it as Parquet first, and loads that."""
        df = read_csv(self.spark, path, multiline)
        if persist:
            df.write.parquet(persist)
            return self.load_parquet(name, persist)
        return self.load(name, df)

    def materialize(self, name: str, sql: str, table: str | None = None, persist: str | None = None) -> dict[str, Any]:
        """Stores a statement's result as a table: as Parquet at a path, else in Spark's storage. Booleans become 0 and 1."""
        began = time.monotonic()
        df = self.query(sql, table)
        twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
        if twice:
            raise ValueError(f"two result columns are named '{twice[0]}'; give them aliases")
        df = df.select(*(df[f"`{c}`"].cast("bigint").alias(c) if t == "boolean" else df[f"`{c}`"] for c, t in df.dtypes))
        if persist:
            df.write.parquet(persist)
            df = self.spark.read.schema(df.schema).parquet(persist)
        else:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        rows = df.count()
        self.load(name, df)
        if persist:
            self._read.add(name)
        self._sorted[name] = _sort_keys(parse(sql), df.columns)
        return {"rows": rows, "elapsed_ms": (time.monotonic() - began) * 1000}

    def remove(self, name: str) -> None:
        self._derived.clear()
        self._tables.pop(name, None)
        if frame := self._frames.pop(name, None):
            frame.unpersist()
        self._last = next(reversed(self._tables), None) if self._last == name else self._last

    def tables(self) -> list[str]:
        return list(self._tables)

    def frame(self, table: str | None = None) -> DataFrame:
        name = table or self._last
        if name not in self._frames:
            raise KeyError(f"no table '{name}' is loaded")
        return self._frames[name]

    def describe(self, table: str | None = None, distinct: bool = False, clustered: bool = False) -> dict[str, Any]:
        """What describe() tells, the columns that a materialized table is sorted by, files and bytes of one that is read from files, and, if asked for, the columns whose values are each one run of rows."""
        name, df = table or self._last, self.frame(table)
        found = describe(df, distinct) | {"sorted_by": self._sorted.get(name, [])}
        if name in self._read:
            found |= files(df)
        return found | ({"clustered": [c for c in df.columns if is_clustered(df, c)]} if clustered else {})

    def warm(self, columns: Sequence[str], table: str | None = None) -> int:
        """Reads some columns into Spark's storage; gives the number of rows."""
        name = table or self._last
        relation = self._tables[name]
        for c in columns:
            if relation.find(c) is None:
                raise KeyError(f"no column '{c}'")
        return relation.df.select(*(relation.find(c).inner for c in columns)).persist(StorageLevel.MEMORY_AND_DISK).count()

    # functions

    def register_function(self, name: str, fn: Callable[..., Any], params: Sequence[str], returns: str, strict: bool = True, variadic: bool = False, optional: int = 0, per_row: bool = False) -> None:
        """fn takes and gives pandas Series, or single values with per_row. A name that is taken, except by a built-in, is replaced."""
        self._loads += 1
        self._functions[name.lower()] = UserFunction(name.lower(), fn, tuple(params), returns, strict, variadic, optional, per_row, self._loads)
        self._derived.clear()

    def unregister_function(self, name: str) -> bool:
        self._derived.clear()
        return self._functions.pop(name.lower(), None) is not None

    # statements

    def query(self, sql: str | Sequence[str], table: str | None = None) -> DataFrame | list[DataFrame]:
        """A frame for a statement, or a list for several, of which those of like shape share a scan."""
        if isinstance(sql, str):
            return self._relation(sql, table).output()
        found = self.query_each(sql, table)
        for i, one in enumerate(found):
            if isinstance(one, SqlError):
                one.message = f"statement {i + 1}: {one.message}"
                raise one
        return found

    def query_each(self, statements: Sequence[str], table: str | None = None) -> list[DataFrame | SqlError]:
        """As query() for several statements, with its error in the place of a statement that cannot be run."""
        return self._batch(list(statements), table)

    def _relation(self, sql: str, table: str | None) -> Relation:
        try:
            return self._binder(table).run(parse(sql))
        except SqlError as e:
            raise e.within(sql) from None

    def _binder(self, table: str | None) -> Binder:
        if table is not None and table not in self._tables:
            near = suggestion(table, self._tables)
            raise KeyError(f"no table '{table}' is loaded" + (f"; closest: {near}" if near else ""))
        return Binder(_View(self, table or self._last))

    def _batch(self, statements: list[str], table: str | None) -> list[DataFrame | SqlError]:
        binder = self._binder(table)
        plans: dict[int, batch.Plan] = {}
        base = self._tables.get(table or self._last or "")
        for i, sql in enumerate(statements):
            try:
                query = parse(sql)
                relation = self._tables.get(query.source.name) or base
                if relation is not None and relation is base:
                    named = replace(relation, fields=tuple(replace(f, table=query.source.alias or query.source.name, own=f.name) for f in relation.fields))
                    if plan := batch.plan_of(binder, query, named):
                        plans[i] = plan
            except (SqlError, TypeError, ValueError):
                continue  # told below, with the statement's number
        out: dict[int, DataFrame | SqlError] = {}
        if len(plans) > 1:
            out = {i: r.output() for i, r in zip(plans, batch.run(binder, list(plans.values())), strict=True)}
        for i, sql in enumerate(statements):
            if i not in out:
                try:
                    out[i] = self._relation(sql, table).output()
                except SqlError as e:
                    out[i] = e
        return [out[i] for i in range(len(statements))]

    # results

    @staticmethod
    def rows(df: DataFrame) -> list[dict[str, Any]]:
        return [r.asDict() for r in df.collect()]

    @staticmethod
    def columns(df: DataFrame, dict_text: bool | str = False) -> pa.Table:
        """Typed columns; dict_text encodes text columns of which fewer than half the values differ, "all" every one."""
        table = df.toArrow()
        for i, f in enumerate(table.schema) if dict_text else ():
            if pa.types.is_string(f.type) or pa.types.is_large_string(f.type):
                coded = table.column(i).combine_chunks().dictionary_encode()
                if dict_text == "all" or 2 * len(coded.dictionary) < max(len(coded), 1):
                    table = table.set_column(i, f.name, coded)
        return table

    # storage

    def cache_stats(self) -> CacheStats:
        d = self._derived
        return CacheStats(len(d.kept), sum(n for _, n in d.kept.values()), d.hits, d.misses, d.evicted)

    def set_cache_budget(self, size: int) -> None:
        self._derived.budget = size
        self._derived.shrink()

    def memory_stats(self) -> dict[str, int]:
        stored = self.spark.sparkContext._jsc.sc().getRDDStorageInfo()
        return {"tables": len(self._tables), "stored_bytes": sum(int(x.memSize() + x.diskSize()) for x in stored)}

    def close(self) -> None:
        self._derived.clear()
        for name in list(self._tables):
            self.remove(name)


def _sort_keys(query: Query, columns: list[str]) -> list[str]:
    """The output columns that a statement's rows are in ascending order of, first things first."""
    names = [Binder.name_of(item, i) for i, item in enumerate(query.items)]
    out = []
    for o in query.order_by:
        if isinstance(o.expr, Literal) and isinstance(o.expr.value, int) and o.expr.value <= len(names):
            name = names[o.expr.value - 1]
        else:
            name = next((n for n, item in zip(names, query.items, strict=True) if o.expr == item.expr or isinstance(o.expr, Column) and o.expr.name == n), None)
        if o.descending or name not in columns:
            break
        out.append(name)
    return out


class _View:
    """The engine's tables and functions as one statement sees them."""

    def __init__(self, engine: Engine, base: str | None):
        self._engine, self._base = engine, base

    def table(self, name: str) -> Relation | None:
        return self._engine._tables.get(name)

    def base(self) -> Relation | None:
        return self._engine._tables.get(self._base) if self._base else None

    def function(self, name: str):
        return self._engine._functions.get(name)

    def function_names(self) -> list[str]:
        return list(self._engine._functions)

    def derived(self, key: str, build: Callable[[], Relation]) -> Relation:
        return self._engine._derived.get(key, build)

    def unique(self, key: str, check: Callable[[], bool]) -> bool:
        """A key's verdict is worked out once for each table."""
        found = self._engine._unique
        if key not in found:
            found[key] = check()
        return found[key]
