"""Connected components of a distributed graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, maybe_broadcast, stored


#: Types of ids whose order in numpy is that of Spark.
_SIMPLE = ("tinyint", "smallint", "int", "bigint", "string")


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, sorted, and the least that each one reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        near = label.copy()
        low = np.minimum(label[x], label[y])
        for end in (x, y):
            np.minimum.at(near, end, low)
            np.minimum.at(near, label[end], low)  # a whole tree moves with its root
        near = near[near]
        if (near == label).all():
            return nodes, nodes[label]
        label = near


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if rows is not None and rows.num_rows:
        kind = rows.schema.field(0).type
        found = least_reached(*(rows[c].to_numpy() for c in ("a", "b")))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in found], ["id", "component"])


def components(edges: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(id, component) of every node of (a, b) edges; component is the least id that can be reached.

    Each round gives a node the least label among its neighbours and itself, then the label of that
    label, so labels cover twice the distance each round. Rows stay as many as nodes; each round is
    written to the shared folder, and the driver sees only whether anything changed. Graphs that are small
    enough to be broadcast take all rounds in one task.
    """
    kind = edges.schema["a"].dataType.simpleString()
    if kind in _SIMPLE and edges.count() <= most:
        return stored(edges.select("a", "b").coalesce(1).mapInArrow(_in_one_task, f"id {kind}, component {kind}"))
    ways = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(ways.unionByName(ways.select("a", F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")))
    while True:
        near = both.join(maybe_broadcast(labels.select(F.col("id").alias("b"), "component")), "b").groupBy(F.col("a").alias("id"))
        pulled = stored(near.agg(F.min("component").alias("next"), F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("old")))
        above = maybe_broadcast(pulled.select(F.col("id").alias("next"), F.col("next").alias("above")))
        jumped = stored(pulled.join(above, "next").select("id", F.col("above").alias("component"), (F.col("above") < F.col("old")).alias("moved")))
        labels = jumped.select("id", "component")
        if not jumped.where("moved").limit(1).count():
            return labels
