"""Substring dedup: repeated passages, found by sharded Aho-Corasick automata.

Words are runs without ASCII white space. A window is WINDOW neighbouring words of one document; every
word of a window whose words also start earlier (in a smaller document id, or at an earlier place of
the same document) is removed.

1. Each window is given an anchor by winnowing: the least hash of GRAM neighbouring words among those
   in the window. Equal windows have equal anchors. Neighbouring windows with one anchor make up a segment.
2. Anchors that occur once cannot lie in a repeated window. Those that recur are confirmed by counts
   summed before the shuffle, and routed back to their documents.
3. Segments of recurring anchors are dealt to shards by anchor. A shard takes them anchor by anchor in
   document order and compiles the windows of a bounded number of segments into an automaton, in which
   the first place of each window stays; streaming the segments through it finds every occurrence,
   and all but the first are repeats. Anchors with very many segments or windows are dealt by window instead, by a
   cryptographic hash of the window's words, with least places computed before the shuffle, so no anchor fills a task.
4. The repeats are routed back to the documents, whose other words are kept.

Null texts have no words. Null ids count as smaller than all others. Rows that repeat an id
are rows of one document: equal windows at equal places of them are not repeats of each other. Of windows that start together in several
rows, none is earlier. An empty table gives no rows. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_batch, chunks, grams, mix, raw, stored, trim

WINDOW, GRAM = 20, 8
#: Segments of one automaton, about.
SHARD_SEGMENTS = 4000
#: Segments of an anchor, and windows of them, up to which they are dealt by anchor; beyond, by window.
ANCHOR_SEGMENTS, ANCHOR_WINDOWS = 4000, 200_000
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Id that stands for null: below all others.
NO_ID = -(1 << 63)


def _running_least(values: np.ndarray, run: int) -> np.ndarray:
    """Least of each run of neighbours, by doubling."""
    have = 1
    while have < run:
        step = min(have, run - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _anchor_rows(docs: DataFrame, window: int, gram: int, times: bool = False) -> DataFrame:
    """(anchor, id, row, first, n): windows first .. first + n - 1 have their least gram's hash in common. All texts of a chunk at once.

    times: adds 2 for anchors whose gram the text has more than once, so that a window may repeat inside one
    segment, and 1 for others.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw(batch.column(1))
        found: list[list[np.ndarray]] = []
        for a, b in chunks(texts):
            w = Words(texts[a:b])
            if len(w.hash) < window:
                continue
            g = grams(w.hash, gram)
            start = np.flatnonzero(w.text[: len(w.text) - window + 1] == w.text[window - 1 :])
            least = _running_least(g, window - gram + 1)[start]
            text = w.text[start]
            edge = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])) if len(start) else np.zeros(0, np.int64)
            one = [least[edge], a + text[edge], start[edge] - w.at[text[edge]], np.diff(np.append(edge, len(start)))]
            if times:
                inside = np.flatnonzero(w.text[: len(g)] == w.text[gram - 1 :])
                with np.errstate(over="ignore"):
                    values, counts = np.unique(g[inside] + mix(w.text[inside].astype(np.uint64)), return_counts=True)
                    one.append(np.where(np.isin(one[0] + mix(text[edge].astype(np.uint64)), values[counts > 1]), 2, 1))
            found.append(one)
        join = lambda k, t: np.concatenate([np.zeros(0, t), *(x[k] for x in found)]).astype(t)
        rows = pa.array(join(1, np.int64))
        arrays = [pa.array(join(0, np.uint64).view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(join(2, np.int32)), pa.array(join(3, np.int32))]
        return pa.RecordBatch.from_arrays([*arrays, *([pa.array(join(4, np.int64))] if times else [])], ["anchor", "id", "row", "first", "n", *(["times"] if times else [])])

    return by_batch(docs, step, "anchor long, id long, row long, first int, n int" + ", times long" * times)


def _segments(docs: DataFrame, window: int) -> DataFrame:
    """From (id, text, row, places): the words of each segment, joined by one space."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], [], []]
        for key, text, row, places in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = _WORDS.findall(text)
            for p in places:
                part = b" ".join(words[p["first"] : p["first"] + p["n"] + window - 1])
                for column, value in zip(out, (p["anchor"], key, row, p["first"], p["n"], p["hot"], part), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["anchor", "id", "row", "first", "n", "hot", "words"])

    return by_batch(docs, step, "anchor long, id long, row long, first int, n int, hot boolean, words binary")


def _codes(segments: list[bytes]) -> list[str]:
    """Segments as strings of one character per word; equal words have equal characters."""
    number: dict[bytes, str] = {}
    free = iter(range(1, 0x110000))
    out = []
    for s in segments:
        for w in (split := s.split(b" ")):
            if w not in number:
                code = next(free)
                while 0xD800 <= code < 0xE000:
                    code = next(free)
                number[w] = chr(code)
        out.append("".join([number[w] for w in split]))
    return out


def repeats_of(rows: list[tuple[int, int, int, int, int, bytes]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(id, row, start, end) word ranges of windows that also start earlier, among (anchor, id, row, first, n, words) rows that hold whole anchors."""
    codes = _codes([r[5] for r in rows])
    machine = ahocorasick.Automaton()
    for (_, key, _, first, n, _), code in zip(rows, codes, strict=True):
        for k in range(n):
            place = key, first + k
            if place < machine.get(code[k : k + window], (math.inf,)):
                machine.add_word(code[k : k + window], place)
    if not len(machine):
        return []
    machine.make_automaton()
    out = []
    for (_, key, row, first, _, _), code in zip(rows, codes, strict=True):
        start = end = -1
        for last, place in machine.iter(code):
            at = first + last - window + 1
            if place < (key, at):
                if at > end:
                    if end >= 0:
                        out.append((key, row, start, end))
                    start = at
                end = at + window
        if end >= 0:
            out.append((key, row, start, end))
    return out


_RANGES = "id long, row long, start int, end int"


def _ranges(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], ["id", "row", "start", "end"])


def _one_phrase(rows: list[tuple], window: int) -> bool:
    """Whether all segments have the same words, and no window twice."""
    words = rows[0][5].split(b" ")
    return len({r[5] for r in rows}) == 1 and len({tuple(words[k : k + window]) for k in range(rows[0][4])}) == rows[0][4]


def _shards(segments: DataFrame, window: int, most: int) -> DataFrame:
    """(id, row, start, end) of repeats. Rows come anchor by anchor; an automaton holds whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows = 0  # of held; summed up again for each anchor, they took a third of the time
        now: list[tuple] = []

        def settled() -> list[tuple[int, int, int, int]]:
            nonlocal held, windows, now
            out = []
            if now and _one_phrase(now, window):  # the first place stays
                least = min((r[1], r[3]) for r in now)
                out = [(r[1], r[2], r[3], r[3] + r[4] + window - 1) for r in now if (r[1], r[3]) != least]
            else:
                held += now
                windows += sum(r[4] for r in now)
            now = []
            if len(held) >= most or windows >= ANCHOR_WINDOWS:
                out += repeats_of(held, window)
                held, windows = [], 0
            return out

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and row[0] != now[0][0]:
                    found += settled()
                now.append(row)
            yield _ranges(found)
        yield _ranges(settled() + repeats_of(held, window))
        held.clear()
        trim()

    ordered = segments.select("anchor", "id", "row", "first", "n", "words").repartition("anchor").sortWithinPartitions("anchor", "id", "first")
    return ordered.mapInArrow(run, _RANGES)


def _by_window(segments: DataFrame, window: int) -> DataFrame:
    """(id, row, start, end) of repeats among segments of anchors with very many of them: least places of each window, told apart by a cryptographic hash of its words."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owners, places, hashes = [], [], [], []
        for key, row, first, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys += [key] * n
            owners += [row] * n
            places += range(first, first + n)
            words = text.split(b" ")
            hashes += [hashlib.blake2b(b" ".join(words[k : k + window]), digest_size=16).digest() for k in range(n)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(owners, pa.int64()), pa.array(places, pa.int32()), pa.array(hashes, pa.binary())], ["id", "row", "first", "window"])

    rows = by_batch(segments.select("id", "row", "first", "n", "words"), step, "id long, row long, first int, window binary")
    least = rows.groupBy("window").agg(F.min(F.struct("id", "first")).alias("place"))
    later = rows.join(least, "window").where((F.col("id") > F.col("place.id")) | (F.col("first") > F.col("place.first")))
    return later.select("id", "row", F.col("first").alias("start"), (F.col("first") + window).cast("int").alias("end"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most: int = SHARD_SEGMENTS, by_anchor: int = ANCHOR_SEGMENTS) -> DataFrame:
    """One row for each row: id, n_words, n_removed, kept (words joined by one space), removed (word ranges, sorted, apart)."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    several = _anchor_rows(rows, window, gram, times=True).groupBy("anchor").agg(F.sum("times").alias("total"), F.sum("n").alias("windows")).where("total > 1")
    hot = (F.col("total") > by_anchor) | (F.col("windows") > ANCHOR_WINDOWS)
    places = _anchor_rows(rows, window, gram).join(several.select("anchor", hot.alias("hot")), "anchor").select("id", "row", "anchor", "first", "n", "hot")
    by_doc = stored(places).groupBy("id", "row").agg(F.collect_set(F.struct("anchor", "first", "n", "hot")).alias("places"))
    segments = stored(_segments(rows.join(by_doc, ["id", "row"]).select("id", "text", "row", "places"), window))
    again = _shards(segments.where("not hot"), window, most)
    if segments.where("hot").limit(1).count():
        again = again.unionByName(_by_window(segments.where("hot"), window))
    again = stored(again)
    ranges = again.groupBy("id", "row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges"))
    joined = rows.join(ranges, ["id", "row"], "left").select("id", "text", "ranges")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept, removed = [], [], [], []
        for text, ranges in zip(raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = _WORDS.findall(text)
            union: list[list[int]] = []
            for r in ranges or ():
                if r["start"] < len(words):
                    if union and r["start"] <= union[-1][1]:
                        union[-1][1] = max(union[-1][1], min(r["end"], len(words)))
                    else:
                        union.append([r["start"], min(r["end"], len(words))])
            left, at = [], 0
            for a, b in union:
                left += words[at:a]
                at = b
            left += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
            removed.append([{"start": a, "end": b} for a, b in union])
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, span)], ["id", "n_words", "n_removed", "kept", "removed"]
        )

    out = by_batch(joined, finish, "id long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))


def digests(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
