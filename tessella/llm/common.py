"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is sent to every executor; larger sides are shuffled.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a local master gets one of its own; a cluster has to name it."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


#: The folders of the workspace()s that this thread is in, the innermost last.
_folders: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables of what is called inside, deleted at its end. Frames made inside are to be read inside.

    Without a workspace, each intermediate table has a folder of its own, which stays until the shared folder is cleared.
    Broadcasts of what was called inside go at its end too.
    """
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
    token = _folders.set((*_folders.get(), path))
    try:
        yield path
    finally:
        _folders.reset(token)
        delete(spark, path)
        release(spark)


def release(spark: SparkSession) -> None:
    """Has executors drop the broadcasts of queries that ended: Spark tells them to once the driver's JVM has collected those queries, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Where the tables are that stored() gave.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, outside: bool = False, compression: str | None = None) -> DataFrame:
    """Writes rows to the shared folder and reads them back: a lost executor costs no recomputation.

    Spark drops the shuffles of the write at its end, as nothing reads them again. outside: the rows outlast the innermost workspace().
    compression: of the files, if not the session's.
    """
    spark = df.sparkSession
    folders = _folders.get()[:-1] if outside else _folders.get()
    path = f"{folders[-1] if folders else shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() gave, before its workspace ends. Frames made of it can't be read any more."""
    delete(df.sparkSession, _paths.pop(df))


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast, if the rows, counted up to the bound, are few enough; else the frame as it is, which Spark shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def sampled(df: DataFrame, most: int) -> DataFrame:
    """At most so many rows of distinct ranks (a column of hashes), the same on every run; rows of equal ranks count as one.

    Rows far from being chosen go before any shuffle, so neither a task nor the driver holds many more.
    """
    n = df.select("rank").count()
    place = F.pmod("rank", F.lit(1 << 30))
    near = df.where(place < int((1 << 30) * 1.5 * most / n)) if n > most else df
    return near.dropDuplicates(["rank"]).orderBy(place, "rank").limit(most)


def commonest(counted: DataFrame, most: int) -> DataFrame:
    """The rows of the largest n, no more than so many. A cutoff from counts of counts sees to that, so that no task gives the driver more than they are."""
    step = F.floor(F.log2("n") * 8).cast("int")
    room, cutoff = most, 1 << 20
    for r in sorted(counted.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        cutoff = r["step"]
    return counted.where(step >= cutoff)


def trim() -> None:
    """Gives freed memory back at a task's end: workers live on, and what each keeps adds to its executor's."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: Most bytes of an Arrow batch, and of the slice of it that a function sees.
BATCH_BYTES, SLICE_BYTES = 2 << 20, 2 << 20


def by_batch(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Arrow batches through a function, without a shuffle. Slices are small in bytes too, so long texts do not add up."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":  # Spark's own limit, with which each worker holds several times as much; a set one stays
        conf.set(key, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, min(2000, SLICE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, size):
                yield step(batch.slice(at, size))
        trim()

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_R = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    if n > len(_powers.get(which, ())):
        with np.errstate(over="ignore"):
            base = np.full(max(n, 1 << 16), _R if which == "up" else _INVERSE, np.uint64)
            base[0] = 1
            _powers[which] = np.multiply.accumulate(base)
    return _powers[which][:n]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class Words:
    """The words of some texts as 64-bit hashes: words[i]:words[i+1] are those of text i.

    Words are the longest runs without space, \\t, \\n, \\v, \\f or \\r. Each hash depends on a
    word's bytes alone. Null texts have no words.
    """

    _SPACE = np.zeros(256, bool)
    _SPACE[[32, 9, 10, 11, 12, 13]] = True

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        gap = self._SPACE[data]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.data = data
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, int)
        self.at = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.at))
        with np.errstate(over="ignore"):
            run = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _power("up", len(data)), dtype=np.uint64)])
            self.hash = mix((run[self.end] - run[self.start]) * _power("down", len(data) + 1)[self.start] + (self.end - self.start).astype(np.uint64))


def grams(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of each k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _R + words[j : j + n]
    return mix(out)


def chunks(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about so many bytes, for arrays of bounded size."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def raw(column: pa.Array) -> list[bytes]:
    """Texts as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
