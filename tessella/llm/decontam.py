"""Benchmark decontamination by winnowing, in DataFrame functions only.

A document's fingerprints are the least hashes of GRAM neighbouring words in each run of
WINDOW - GRAM + 1 such grams, so any WINDOW words that a document shares with an item have a
fingerprint in common. Documents that share fingerprints with items are candidates; their
windows are then compared word by word, and the hits are joined to maximal runs. An item of
fewer than WINDOW words is one window: its fingerprint is the least hash of its words.

Words are runs of digits, lower-case letters and non-ASCII characters once A-Z are lower-cased.
Null texts have no words; items without words or with a null id take no part. Rows that repeat
an item id count as one item with the windows of all of them. Rows that repeat a document id are
judged apart unless their texts are equal too, in which case they get equal results. Without items, or without items that have words, nothing is
hit; an empty table gives no rows. Columns other than those named are not read, whatever their names; clean() passes the documents' on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

WINDOW, GRAM = 8, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once: a lambda variable, where a column would be computed anew for each use."""
    return F.transform(F.array(value), body)[0]


def _least(hashes: Column, run: int) -> Column:
    """The distinct least values of each run of neighbours."""
    windows = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (run - 1), F.lit(0)))
    if run == 1:
        return F.array_distinct(windows)
    return F.array_distinct(F.transform(windows, lambda x, i: F.least(x, *(F.get(hashes, i + j) for j in range(1, run)))))


def fingerprints(words: Column, sizes: list[int]) -> Column:
    """Fingerprints of windows of each size, as an array; a size below WINDOW is used for short items."""

    def of(hashes: Column, size: int) -> Column:
        if size < WINDOW:
            return F.transform(_least(hashes, size), lambda x: F.xxhash64(x, F.lit(size)))
        starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (GRAM - 1), F.lit(0)))
        grams = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(hashes, i + j) for j in range(1, GRAM))))
        return _let(grams, lambda g: _least(g, WINDOW - GRAM + 1))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(*(of(h, s) for s in sizes)))


def _windows(words: Column, size: int) -> Column:
    """All windows of a size, as structs of start, size and text."""
    return F.when(
        F.size(words) >= size,
        F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.struct(i.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice(words, i + 1, size), " ").alias("window"))),
    ).otherwise(F.array().cast("array<struct<start:int,size:int,window:string>>"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document row: id, text_hash, n_words, n_hit, item_ids (sorted strings), spans (maximal hit runs, as word offsets)."""
    bench = items.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") > 0))
    bench = bench.withColumn("size", F.least(F.size("words"), F.lit(WINDOW)))
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # WINDOW values at most
    doc = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    counted = doc.select("id", "text_hash", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    span = "array<struct<start:int,end:int>>"
    if not sizes:
        return counted.select("*", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"), F.array().cast(span).alias("spans"))

    item_prints = None
    for size in sizes:
        part = bench.where(F.col("size") == size).select(F.explode(fingerprints(F.col("words"), [size])).alias("print"))
        item_prints = part if item_prints is None else item_prints.unionByName(part)
    item_prints = stored(item_prints.distinct())
    prints = doc.select("id", "text_hash", F.explode(fingerprints(words_of(F.col("text")), sizes)).alias("print"))
    suspects = stored(prints.join(maybe_broadcast(item_prints), "print", "left_semi").select("id", "text_hash").distinct())

    each = None
    for size in sizes:
        part = bench.where(F.col("size") == size).select(F.col("item_id").cast("string").alias("item_id"), F.explode(_windows(F.col("words"), size)).alias("w")).select("item_id", "w.size", "w.window")
        each = part if each is None else each.unionByName(part)
    each = stored(each.distinct())
    seen = maybe_broadcast(suspects).alias("s")
    near = doc.alias("d").join(seen, F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left_semi")
    near = near.select("id", "text_hash", words_of(F.col("text")).alias("words"))
    # rows that repeat an id and its text would count each hit more than once; collect_set takes care of that
    shown = near.select("id", "text_hash", F.explode(F.concat(*(_windows(F.col("words"), s) for s in sizes))).alias("w")).select("id", "text_hash", "w.*")
    hits = shown.join(maybe_broadcast(each), ["size", "window"])
    by_doc = hits.groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("raw"), F.sort_array(F.collect_set("item_id")).alias("item_ids")
    )
    none = F.array().cast(span)
    grow = lambda done, w: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= w["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], w["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(w)))
    joined = by_doc.select("id", "text_hash", "item_ids", F.aggregate("raw", none, grow).alias("spans"))
    out = counted.alias("c").join(joined.alias("h"), F.col("c.id").eqNullSafe(F.col("h.id")) & (F.col("c.text_hash").eqNullSafe(F.col("h.text_hash"))), "left")
    spans = F.coalesce(F.col("h.spans"), none)
    return out.select(
        "c.id",
        "c.text_hash",
        "c.n_words",
        F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long").alias("n_hit"),
        F.coalesce(F.col("h.item_ids"), F.array().cast("array<string>")).alias("item_ids"),
        spans.alias("spans"),
    )


def verdicts(found: DataFrame, least_items: int = 2) -> DataFrame:
    n = F.size("item_ids").cast("long")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, least_items: int = 1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without passages of so many items, with all their columns.

    A passage is WINDOW words at least: shorter items, which any text may have by chance, count for nothing. Null and
    empty texts stay, and so does every document where there are no items. Rows that repeat an id are judged by their own texts.
    """
    long = items.where(F.size(words_of(F.col(item_text_col))) >= WINDOW).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    found = decontaminate(docs, long, id_col, text_col)
    bad = stored(found.where(F.size("item_ids") >= least_items).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    same = docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["__hash"])
    return docs.join(maybe_broadcast(bad), same, "left_anti")
