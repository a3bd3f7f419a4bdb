"""What a table holds, in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import Kind, kind_of


def describe(df: DataFrame, distinct: bool = False) -> dict[str, Any]:
    """rows, partitions that have rows, and for each column kind, nulls, and min and max of numbers and dates; distinct counts (approximate) if asked for."""
    asked = [F.count(F.lit(1)).alias("rows"), F.count_distinct("__partition").alias("partitions")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name.replace('`', '``')}`")
        asked.append(F.count(F.when(c.isNull(), 1)).alias(f"nulls{i}"))
        if kind_of(f.dataType) not in (Kind.TEXT, Kind.BOOL, Kind.NULL):
            asked += [F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}")]
        if distinct:
            asked.append(F.approx_count_distinct(c).alias(f"distinct{i}"))
    row = df.select("*", F.spark_partition_id().alias("__partition")).agg(*asked).first().asDict()
    columns = []
    for i, f in enumerate(df.schema.fields):
        entry = {"name": f.name, "kind": kind_of(f.dataType).value, "nulls": row[f"nulls{i}"]}
        entry |= {k: row[f"{k}{i}"] for k in ("min", "max", "distinct") if f"{k}{i}" in row}
        columns.append(entry)
    return {"rows": row["rows"], "partitions": row["partitions"], "columns": columns}


def files(df: DataFrame) -> dict[str, int]:
    """files and bytes of a frame that reads files; of those alone that have rows."""
    each = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    row = each.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")).first()
    return {"files": row["files"], "bytes": row["bytes"]}


def is_clustered(df: DataFrame, column: str) -> bool:
    """Whether each value that is not NULL is one run of rows in file order.

    Each partition tells how many runs it has and its first and last values; only those, a row for each partition, meet on the driver.
    """
    values = df.select(F.col(column).alias("v"))
    kind = values.schema["v"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last, place = 0, None, None, TaskContext.get().partitionId()
        any_row = False
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(0)
            filled = pc.is_valid(v).to_numpy(zero_copy_only=False)
            same = pc.fill_null(pc.equal(v[1:], v[:-1]), False).to_numpy(zero_copy_only=False)
            n += int((filled[1:] & ~same).sum())
            if any_row:
                n += bool(filled[0]) and v[0] != last
            else:
                first, any_row = v[0], True
            last = v[-1]
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([n], pa.int64()), pa.array([first.as_py()], v.type), pa.array([last.as_py()], v.type)], ["place", "n", "first", "last"])

    found, starts, last = values.mapInArrow(runs, f"place int, n long, first {kind}, last {kind}").orderBy("place").collect(), 0, None
    for r in found:
        starts += r["n"] + (r["first"] is not None and r["first"] != last)
        last = r["last"]
    return starts == values.where("v is not null").agg(F.count_distinct("v")).first()[0]
