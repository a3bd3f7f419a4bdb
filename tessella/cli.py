"""Command line: convert, inspect, query, materialize and join tables.

``python -m tessella.cli query table.parquet "select count(*) as n from t"``; without a statement, query reads
statements from the terminal.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable, Iterator
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .operators.joins import dimension_join
from .plans.diagnostics import SqlError


def _loaded(engine: Engine, name: str, path: str) -> DataFrame:
    return engine.load_csv(name, path) if path.lower().endswith((".csv", ".csv.gz")) else engine.load_parquet(name, path)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessella", description="Faceted analytics on immutable tables.")
    sub = parser.add_subparsers(dest="command", required=True)
    convert = sub.add_parser("convert", help="CSV to Parquet, with sniffed types")
    convert.add_argument("source")
    convert.add_argument("target")
    inspect = sub.add_parser("inspect", help="rows, kinds, NULLs, least and greatest values")
    inspect.add_argument("source")
    query = sub.add_parser("query", help="run a statement, or read statements")
    query.add_argument("source")
    query.add_argument("sql", nargs="?")
    query.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="another table to join with")
    query.add_argument("--rows", type=int, default=50, help="most rows that are shown")
    query.add_argument("--bench", type=int, metavar="N", help="time the statement N times")
    make = sub.add_parser("materialize", help="store a statement's result as Parquet")
    make.add_argument("source")
    make.add_argument("sql")
    make.add_argument("target")
    join = sub.add_parser("join", help="join facts with a dimension and store the result")
    join.add_argument("facts")
    join.add_argument("dims")
    join.add_argument("target")
    join.add_argument("--on", action="append", required=True, metavar="A=B")
    join.add_argument("--how", choices=("left", "inner"), default="left")
    join.add_argument("--columns")
    return parser


def _show(df: DataFrame, rows: int, out) -> None:
    print(df.limit(rows).toPandas().to_string(index=False), file=out)


def main(args: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = _parser().parse_args(args)
    engine = Engine(spark or SparkSession.builder.getOrCreate())
    try:
        if a.command == "convert":
            engine.load_csv("t", a.source, persist=a.target)
            print(f"{engine.frame('t').count()} rows", file=out)
        elif a.command == "inspect":
            _loaded(engine, "t", a.source)
            found = engine.describe("t", distinct=True)
            print(f"{found['rows']} rows", file=out)
            for c in found["columns"]:
                print("  " + "  ".join(f"{k} {v}" if k != "name" else str(v) for k, v in c.items()), file=out)
        elif a.command == "query":
            for pair in a.table:
                name, _, path = pair.partition("=")
                _loaded(engine, name, path)
            _loaded(engine, "t", a.source)
            for sql in [a.sql] if a.sql else _statements(sys.stdin):
                _answer(engine, sql, a, out)
        elif a.command == "materialize":
            _loaded(engine, "t", a.source)
            print(f"{engine.materialize('result', a.sql, 't', persist=a.target)['rows']} rows", file=out)
        else:
            facts, dims = _loaded(engine, "facts", a.facts), _loaded(engine, "dims", a.dims)
            on = [tuple((p if "=" in p else f"{p}={p}").split("=", 1)) for p in a.on]
            dimension_join(facts, dims, on, a.how, a.columns.split(",") if a.columns else None).write.parquet(a.target)
    except (SqlError, ValueError, KeyError, TypeError) as e:
        print(e, file=out)
        return 1
    return 0


def _statements(lines: Iterable[str]) -> Iterator[str]:
    """Statements of one line or several, each up to a line that ends with a semicolon, an empty line, or the end."""
    now: list[str] = []
    for line in lines:
        if line.strip():
            now.append(line)
        if now and (not line.strip() or line.rstrip().endswith(";")):
            yield "".join(now)
            now = []
    if now:
        yield "".join(now)


def _answer(engine: Engine, sql: str, a: argparse.Namespace, out) -> None:
    try:
        _show(engine.query(sql, "t"), a.rows, out)
        if a.bench:
            times = []
            for _ in range(a.bench):
                began = time.monotonic()
                engine.query(sql, "t").write.format("noop").mode("overwrite").save()
                times.append((time.monotonic() - began) * 1000)
            print(f"median {median(times):.1f} ms of {a.bench}", file=out)
    except SqlError as e:
        if a.sql:
            raise
        print(e, file=out)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
