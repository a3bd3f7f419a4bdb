"""Approximate nearest neighbours by cross-polytope hashing.

A vector, scaled to unit length, is turned by a fast pseudo-rotation (three rounds of random signs
and a Hadamard transform) and assigned to the nearest signed axis. Each of several tables concatenates the
axes of as many rotations as give at least as many buckets as there are vectors. A query probes, in each table, the buckets
whose axes have the largest sum of its own coordinates; their number falls with the root of the number of vectors, as a share of
all buckets, so what a query reads grows with that root. All vectors of those buckets are reranked by exact
Euclidean distance in double precision.

Tasks hold the buckets that begin with the same axes, large ones in blocks, and return each query's best. Distances that
a bounded sample shows to be far beyond the nearest ones are not returned; where that or the probes leave a query with fewer than TOP, it reads every vector,
so that none is short while others remain.

Vectors of different lengths have no distance; a query searches those of its own length. Rows that share a vector make up one
candidate with the TOP + 1 smallest of their ids: no query can return more of them. Vectors that are null, empty, zero, or that hold
null or non-finite components take no part; nor does a row with a null id. An id stands for a row: rows that repeat an id
and a vector count once, and a query never returns its own id. Ties go to the smaller id. An empty table, or one without queries, gives
no rows. Columns other than the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, maybe_broadcast, stored

TOP = 10
TABLES = 16
#: By how much the share of a table's buckets that a query probes exceeds 1 over the levels and the root of the number of vectors.
EAGERNESS = 1.3
#: Most vectors, and most queries, of one block.
BLOCK = 20_000
QUERY_BLOCK = 5_000
#: Most vectors of the sample that bounds distances, and about how many of all vectors stay within the bound.
SAMPLE, WITHIN = 8192, 200


@dataclass(frozen=True)
class Plan:
    """Rotations of a table, those of them by which tasks are dealt, and buckets that a query probes."""

    levels: int
    group_levels: int
    probes: int


def plan_for(n: int, axes: int) -> Plan:
    levels = group = 1
    while axes**levels < n and levels < 6:
        levels += 1
    while n > BLOCK * axes**group and group < levels:
        group += 1
    share = EAGERNESS / (levels * math.sqrt(max(n, 1)))
    return Plan(levels, group, min(axes**levels, max(1, math.ceil(share * axes**levels))))


@lru_cache(maxsize=8)
def _signs(tables: int, levels: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, levels, 3, width))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(n, width) / np.sqrt(width)


def _width(length: int) -> int:
    return 1 << max(0, length - 1).bit_length()


def rotated(vectors: np.ndarray, table: int, levels: int, tables: int = TABLES, seed: int = 5) -> np.ndarray:
    """Unit vectors under a table's rotations, as coordinates of 2 * width signed axes: shape (levels, rows, axes)."""
    width = _width(vectors.shape[1])
    unit = vectors / np.max(np.abs(vectors), 1, keepdims=True)
    unit = np.pad(unit / np.linalg.norm(unit, axis=1, keepdims=True), ((0, 0), (0, width - vectors.shape[1])))
    out = []
    for signs in _signs(tables, levels, width, seed)[table]:
        x = unit
        for s in signs:
            x = _hadamard(x * s)
        out.append(np.concatenate([x, -x], 1))
    return np.stack(out)


def probed(coordinates: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the buckets with the largest sums of coordinates, given as (levels, axes). Axes far down in all rotations are passed over."""
    levels, axes = coordinates.shape
    most = min(axes, math.ceil(2 * probes ** (1 / levels)) + 1)
    bucket, total = np.zeros(1, np.int64), np.zeros(1)
    for x in coordinates:
        first = np.argpartition(-x, most - 1)[:most]
        bucket, total = (bucket[:, None] * axes + first).ravel(), (total[:, None] + x[first]).ravel()
        if len(total) > probes:  # the best sums begin with best sums
            best = np.argpartition(-total, probes - 1)[:probes]
            bucket, total = bucket[best], total[best]
    return bucket


def _by_length(packed: list[bytes], kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, the places of its vectors and a matrix of them."""
    length = np.array([len(x) for x in packed], np.int64) // np.dtype(kind).itemsize
    out = {}
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        out[int(n)] = at, np.frombuffer(b"".join(packed[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)
    return out


_SHAPE = "length int, table int, bucket long"


def _indexed(index: DataFrame, n: int, tables: int, seed: int, kind: str) -> DataFrame:
    """Each vector once per table: length, table, bucket (the first axes, by which tasks are dealt), code (the others), h1, h2, ids, vector."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[np.zeros(0, np.int64)] for _ in range(5)]
        for length, (at, vectors) in _by_length(batch.column(3).to_pylist(), kind).items():
            axes = 2 * _width(length)
            plan = plan_for(n, axes)
            for table in range(tables):
                nearest = rotated(vectors, table, plan.levels, tables, seed).argmax(2)
                number = np.zeros(len(at), np.int64)
                for axis in nearest:
                    number = number * axes + axis
                rest = axes ** (plan.levels - plan.group_levels)
                for column, value in zip(found, (at, np.full(len(at), length), np.full(len(at), table), number // rest, number % rest), strict=True):
                    column.append(value)
        at, length, table, bucket, code = (np.concatenate(x) for x in found)
        picked = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays(
            [pa.array(length.astype(np.int32)), pa.array(table.astype(np.int32)), pa.array(bucket), pa.array(code), *picked.columns], ["length", "table", "bucket", "code", "h1", "h2", "ids", "vector"]
        )

    return by_batch(index.select("h1", "h2", "ids", "vector"), step, f"{_SHAPE}, code long, h1 long, h2 long, ids array<long>, vector binary")


def _asking(queries: DataFrame, n: int, tables: int, seed: int, kind: str, sample: list[bytes]) -> DataFrame:
    """Each query once per table and task it asks: length, table, bucket, codes (packed), reach, h1, h2, vector."""
    known = queries.sparkSession.sparkContext.broadcast({k: v for k, (_, v) in _by_length(sample, kind).items()})
    beyond = max(TOP + 1, math.ceil(WITHIN * len(sample) / max(n, 1)))

    def reach(vectors: np.ndarray, length: int) -> np.ndarray:
        near = known.value.get(length, np.zeros((0, length)))
        if len(near) <= beyond:
            return np.full(len(vectors), np.inf)
        return np.array([np.partition(np.sqrt(((near - v) ** 2).sum(1)), beyond)[beyond] for v in vectors])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for length, (at, vectors) in _by_length(batch.column(2).to_pylist(), kind).items():
            axes = 2 * _width(length)
            plan = plan_for(n, axes)
            rest = axes ** (plan.levels - plan.group_levels)
            far = reach(vectors, length)
            for table in range(tables):
                turned = rotated(vectors, table, plan.levels, tables, seed)
                for i, row in enumerate(at):
                    bucket = np.sort(probed(turned[:, i], plan.probes))
                    edge = np.flatnonzero(np.diff(bucket // rest, prepend=-1))
                    for a, b in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
                        for column, value in zip(out, (row, length, table, bucket[a] // rest, (bucket[a:b] % rest).astype(_code_kind(rest)).tobytes(), far[i]), strict=True):
                            column.append(value)
        picked = batch.take(pa.array(out[0], pa.int64()))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64())
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True)), *picked.columns], ["length", "table", "bucket", "codes", "reach", "h1", "h2", "vector"])

    return by_batch(queries.select("h1", "h2", "vector"), step, f"{_SHAPE}, codes binary, reach double, h1 long, h2 long, vector binary")


def _code_kind(rest: int) -> str:
    return "<u2" if rest <= 1 << 16 else "<i8"


def _packed(df: DataFrame, columns: list[str], vec: str, kind: str) -> DataFrame:
    """The array column as little-endian numbers, in one binary value."""
    ddl = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(vec)
        column = batch.column(at)
        values, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(kind), column.offsets.to_numpy()
        offsets = offsets - offsets[0]
        packed = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(packed, pa.binary())], [*columns, "vector"])

    return by_batch(df.select(*columns, vec), step, f"{ddl}, vector binary")


def _valid(vec: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vec, number) & F.exists(vec, lambda x: x != 0), F.lit(False))


_TASK = ["length", "table", "bucket"]


def _dealt(vectors: DataFrame, asking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with part and query_part: the blocks of tasks that have very many vectors or queries; each block of one side meets each of the other."""
    large = lambda df, most, name: df.groupBy(*_TASK).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name)).where(F.col(name) > 1)
    blocks = stored(large(vectors, BLOCK, "parts").join(large(asking, QUERY_BLOCK, "query_parts"), _TASK, "full"))
    blocks = maybe_broadcast(blocks.na.fill(1))
    one, each = lambda c: F.coalesce(c, F.lit(1)), lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    own = lambda c: F.pmod("h1", one(c)).cast("int")
    left = vectors.join(blocks, _TASK, "left").withColumn("part", own("parts")).withColumn("query_part", each("query_parts"))
    right = asking.join(blocks, _TASK, "left").withColumn("query_part", own("query_parts")).withColumn("part", each("parts"))
    return left.drop("parts", "query_parts"), right.drop("parts", "query_parts")


def _best(kind: str, n: int, top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Each query's nearest among a task's vectors of the buckets that it probes, of all of them if codes is null."""

    def nearest(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("q1", "q2", "h1", "h2", "ids", "score")}
        if vectors.num_rows and asking.num_rows:
            length = vectors["length"][0].as_py()
            plan = plan_for(n, 2 * _width(length))
            code_kind = _code_kind((2 * _width(length)) ** (plan.levels - plan.group_levels))
            code = vectors["code"].to_numpy()
            order = np.argsort(code, kind="stable")
            code = code[order]
            points = np.frombuffer(b"".join(vectors["vector"].to_pylist()), kind).reshape(len(order), length).astype(np.float64)[order]
            ids = vectors["ids"].to_pylist()
            first = np.array([x[0] for x in ids])[order]
            h1, h2 = vectors["h1"].to_numpy()[order], vectors["h2"].to_numpy()[order]
            columns = (asking[c].to_pylist() for c in ("h1", "h2", "vector", "codes", "reach"))
            for q1, q2, vector, codes, reach in zip(*columns, strict=True):
                near = np.arange(len(order))
                if codes is not None:
                    asked = np.frombuffer(codes, code_kind).astype(np.int64)
                    a, b = np.searchsorted(code, asked), np.searchsorted(code, asked, side="right")
                    size = b - a
                    near = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                score = np.sqrt(((points[near] - np.frombuffer(vector, kind).astype(np.float64)) ** 2).sum(1))
                close = np.flatnonzero(score <= reach)
                if len(close) > top + 1:
                    close = close[score[close] <= np.partition(score[close], top)[top]]
                close = close[np.lexsort((first[near[close]], score[close]))][: top + 1]
                near, score = near[close], score[close]
                out["q1"] += [q1] * len(near)
                out["q2"] += [q2] * len(near)
                out["h1"] += h1[near].tolist()
                out["h2"] += h2[near].tolist()
                out["ids"] += [ids[k] for k in order[near]]
                out["score"] += score.tolist()
        return pa.table({k: pa.array(v, pa.list_(pa.int64()) if k == "ids" else pa.float64() if k == "score" else pa.int64()) for k, v in out.items()})

    return nearest


_FOUND = "q1 long, q2 long, h1 long, h2 long, ids array<long>, score double"


def _search(vectors: DataFrame, asking: DataFrame, kind: str, n: int, top: int) -> DataFrame:
    """(q1, q2, h1, h2, ids, score): each query's best candidates of each task."""
    left, right = _dealt(vectors, asking)
    keys = [*_TASK, "part", "query_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(kind, n, top), _FOUND)


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, tables: int = TABLES, seed: int = 5
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row for which is_query(a column over vec_id) holds."""
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"  # a float is the same number as a double
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & _valid(F.col("v"))).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    rows = _packed(rows, ["vec_id", "h1", "h2"], "v", kind).dropDuplicates(["vec_id", "h1", "h2"])
    # a rank under a limit is cut before the shuffle too, so a vector that very many rows share stays small
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("n") <= top + 1)
    index = stored(first.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("h1", "h2", "vector", "ids"))
    asking = stored(rows.where(is_query).select("vec_id", "h1", "h2", "vector"))
    distinct = asking.dropDuplicates(["h1", "h2"]).select("h1", "h2", "vector")
    n = index.count()
    sample = [bytes(r["vector"]) for r in index.orderBy("h1", "h2").limit(SAMPLE).select("vector").collect()]
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def answers(found: DataFrame, asked: DataFrame) -> DataFrame:
        one = found.dropDuplicates(["q1", "q2", "h1", "h2"]).select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
        best = one.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "vec_id"))).where(F.col("n") <= top + 1)
        pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).join(best.drop("n"), ["q1", "q2"])
        ranked = pairs.where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(by_query))
        return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

    found = stored(answers(_search(_indexed(index, n, tables, seed, kind), _asking(distinct, n, tables, seed, kind, sample), kind, n, top), asking))
    enough = found.where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"))
    short = stored(asking.join(enough, "vec_id", "left_anti"))
    if not short.limit(1).count():
        return found
    one = lambda df: df.withColumn("length", (F.octet_length("vector") / int(kind[2])).cast("int")).withColumn("table", F.lit(0)).withColumn("bucket", F.lit(0).cast("long"))
    every = one(index).withColumn("code", F.lit(0).cast("long"))
    asked = one(short.dropDuplicates(["h1", "h2"]).select("h1", "h2", "vector")).withColumn("codes", F.lit(None).cast("binary")).withColumn("reach", F.lit(math.inf))
    whole = answers(_search(every, asked, kind, n, top), short)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
