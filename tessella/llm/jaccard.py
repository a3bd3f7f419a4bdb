"""N-gram Jaccard join by filtering under several global token orders.

Tokens are the distinct shingles of WORDS words of a text. Two sets of a Jaccard similarity of at
least PERCENT / 100 share a token among the first n - ceil(PERCENT / 100 * n) + 1 of each, under any
global order of all tokens. The first order sorts by how rare a shingle's rarest word is: only documents that share
such a prefix token are candidates. Of these, the prefixes under two further orders must share a token as well, and
the sizes and sketches (counts of tokens in buckets, which bound the overlap) must allow a link, before the texts of a
pair are brought together. Pairs whose shingles' hashes link are compared once more by the shingles' words.

Equal texts are one text, by SHA-256. Members of a list, those that share a token, are compared with HUBS of
them only, and those found alike make up a component. That is first done with the very first tokens under FIRSTS orders, which
most sets that link share, so that most copies are in one component before the whole prefixes are listed. Of the lists of prefix tokens, only
those of several components are then made. The hubs leave a list, as they have met all of it. Lists that still
hold several components are of sets that share much but do not link, such as texts made from one by many changes. Their members, and
they alone, are listed anew under a further order, in which the tokens of such lists come last, and those of lists that are open even then by prefixes of their
differences from a pivot (see _apart), in which what most of them share does not occur; again with hubs, in the end MORE times as many each time, until every list is of one component or used up.
So a list is never compared with itself, a group of copies costs comparisons in proportion to its members, and yet any two sets that
could link are compared or known to be in one component: they share a list, and as long as that stays open, both are listed anew, and share one again.

Null texts and texts without words have an empty set and link with nothing. Rows that repeat an id
link with each other through the id. A null id takes part as a document whose component is null. An empty table gives an empty
result. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Words, by_batch, chunks, commonest, discard, grams, maybe_broadcast, mix, raw, stored, workspace
from .graph import components

WORDS, PERCENT = 5, 80
#: Words that the first order tells apart by how common they are; all others are equally rare.
COMMON_WORDS = 1 << 16


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Positions-free hashes of the shingles in order, repeats included; fewer words than k make one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return grams(words, k) if len(words) >= k else grams(words, len(words), 2 + len(words))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def chunk_sets(w: Words, k: int, rarity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token, rarity) of the distinct shingles of all texts of a chunk, by text, then token. A shingle is as common as its rarest word."""
    words, text = w.hash, w.text
    common = np.zeros(len(words), np.int64) if rarity is None else rarity
    start = np.flatnonzero(text[: max(len(text) - k + 1, 0)] == text[k - 1 :])
    token, owner, rare = grams(words, k)[start], text[start], common[start]
    for j in range(1, k):
        rare = np.minimum(rare, common[start + j])
    count = np.diff(w.at)
    short = np.flatnonzero((count > 0) & (count < k))  # one shingle each
    if len(short):
        token = np.concatenate([token, *(shingles(words[w.at[i] : w.at[i + 1]], k) for i in short)])
        owner = np.concatenate([owner, short])
        rare = np.concatenate([rare, [common[w.at[i] : w.at[i + 1]].min() for i in short]])
    order = np.lexsort((token, owner))
    token, owner, rare = token[order], owner[order], rare[order]
    if len(token):
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
        token, owner, rare = token[new], owner[new], rare[new]
    return owner, token, rare


def prefixes(owner: np.ndarray, token: np.ndarray, rare: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) of the first tokens of each set under the order of rarity, then hash, then token."""
    if not len(token):
        return owner, token
    place = (owner.astype(np.uint64) << np.uint64(48)) | (np.minimum(rare, LAST).astype(np.uint64) << np.uint64(43)) | (mix(token) >> np.uint64(21))
    order = np.argsort(place, kind="stable")
    owner, token = owner[order], token[order]
    edge = np.flatnonzero(np.diff(owner, prepend=-1))
    n = np.diff(np.append(edge, len(owner)))
    first = np.arange(len(owner)) - np.repeat(edge, n) < np.repeat(n - -(-percent * n // 100) + 1, n)
    return owner[first], token[first]


#: The place of the tokens that come last, and most tokens that are given it, those of the longest lists first.
LAST, LAST_TOKENS = 31, 1 << 18


def _rarity(words: np.ndarray, hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How common each word is; 0 for those that the list does not have."""
    if not len(hashes):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    return np.where(hashes[at] == words, ranks[at], 0)


#: Orders beside the first one.
ORDERS = 2


def other_prefixes(tokens: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """Prefixes of a set of distinct tokens under orders by seeded hashes."""
    n = prefix_size(len(tokens), percent)
    return [tokens[np.argpartition(h, n - 1)[:n]] if n < len(tokens) else tokens for h in (mix(tokens + np.uint64(11 + i)) for i in range(ORDERS))]


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets of distinct tokens link."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def word_shingles(text: bytes, k: int = WORDS) -> set[bytes]:
    """The distinct shingles themselves."""
    words = text.lower().split()  # of bytes: A-Z are lower-cased, and ASCII white space parts words
    return {b" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def _common_words(docs: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in most documents, sorted, and 1 more for each doubling of their documents' number."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw(batch.column(1))
        seen = [np.zeros(0, np.uint64)]
        for a, b in chunks(texts):
            w = Words(texts[a:b], lower=True)
            seen += [np.unique(w.hash[w.at[i] : w.at[i + 1]]) for i in range(b - a)]
        hashes, n = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    with workspace(docs.sparkSession):
        counted = stored(by_batch(docs, count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
        hashes, n = _most_common(counted, "word", limit)
    return hashes, np.floor(np.log2(n + 1)).astype(np.int64)


def _most_common(counted: DataFrame, key: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the largest n, sorted, and their n: no more than the limit."""
    top = commonest(counted, limit).select(key, "n").toPandas()
    hashes = top[key].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top["n"].to_numpy(np.float64)[order]


def fine_sketch(scrambled: np.ndarray) -> bytes:
    """Counts in a power of two of buckets, so that those of a larger set can be folded. Empty, which rules nothing out, if one does not fit."""
    buckets = 1 << max(5, (len(scrambled) // 2).bit_length())
    counts = np.bincount((scrambled & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int = PERCENT) -> bool:
    """Whether sets of sizes n and m with such sketches can link: they differ in no fewer tokens than their sketches do."""
    differ = abs(n - m)
    if x and y:
        a, b = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (x, y))
        few = min(len(a), len(b))
        differ = int(np.abs(a.reshape(-1, few).sum(0) - b.reshape(-1, few).sum(0)).sum())
    both = (n + m - differ) // 2
    return 100 * both >= percent * (n + m - both)


#: Orders whose very first tokens are compared before any prefix is.
FIRSTS = 4


def first_tokens(token: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Keys of the first tokens of each set that is not empty, one for each order; sets are token[edge[i]:edge[i + 1]]."""
    start = edge[:-1][edge[1:] > edge[:-1]]
    if not len(start):
        return np.zeros((0, FIRSTS), np.uint64)
    return np.stack([np.minimum.reduceat(mix(token + np.uint64(51 + i)), start) + np.uint64(i) for i in range(FIRSTS)], 1)


def packed_orders(tokens: np.ndarray, percent: int = PERCENT) -> bytes:
    """The prefixes under the further orders, one after the other, each token cut to 32 bits: equal tokens stay equal."""
    return b"".join((x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for x in other_prefixes(tokens, percent))


def orders_meet(x: bytes, y: bytes) -> bool:
    """Whether both further orders' prefixes share a token."""
    a, b = (np.frombuffer(s, "<u4").reshape(ORDERS, -1) for s in (x, y))
    return all(np.isin(p, q).any() for p, q in zip(a, b, strict=True))


def _sets(texts: DataFrame, k: int, percent: int, common: tuple[np.ndarray, np.ndarray], kind: str) -> DataFrame:
    """(id, digest, n, firsts, prefix, orders, sketch): each set's size, its first tokens, its prefix of the first order, those of the others, and its sketch."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw(batch.column(2))
        n, orders, sketches = [], [], []
        tokens, sizes, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, FIRSTS), np.uint64)]
        for a, b in chunks(texts):
            w = Words(texts[a:b], lower=True)
            owner, token, rare = chunk_sets(w, k, _rarity(w.hash, *shared.value))
            edge = np.searchsorted(owner, np.arange(b - a + 1))
            n += np.diff(edge).tolist()
            scrambled = mix(token + np.uint64(21))
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                orders.append(packed_orders(token[x:y], percent) if y > x else b"")
                sketches.append(fine_sketch(scrambled[x:y]))
            first, prefix = prefixes(owner, token, rare, percent)
            tokens.append(prefix)
            sizes.append(np.bincount(first, minlength=b - a))
            least.append(first_tokens(token, edge))
        listed = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))
        firsts = listed(FIRSTS * (np.array(n, np.int64) > 0), np.concatenate(least).ravel())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), firsts, listed(np.concatenate(sizes), np.concatenate(tokens)), pa.array(orders, pa.binary()), pa.array(sketches, pa.binary())],
            ["id", "digest", "n", "firsts", "prefix", "orders", "sketch"],
        )

    return by_batch(texts.select("id", "digest", "text"), step, f"id {kind}, digest binary, n long, firsts array<long>, prefix array<long>, orders binary, sketch binary")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that may link: by the prefixes under the further orders, and by the sketches."""
    asked = lambda c: maybe_broadcast(pairs.select(c).distinct())
    side = lambda c: sets.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("orders", "sketch", "n"))).join(asked(c), c, "left_semi")
    wide = side("a").join(maybe_broadcast(pairs), "a").join(side("b"), "b").where(_sizes_allow("a_n", "b_n", percent)).select("a", "b", "a_orders", "b_orders", "a_sketch", "b_sketch", "a_n", "b_n")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True)
        keep = [orders_meet(p, q) and may_link(*rest, percent) for p, q, *rest in rows]
        return pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return by_batch(wide, step, f"a {kind}, b {kind}").distinct()


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _verified(left: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) pairs whose texts link, by their words. Each pair's texts meet in one row, so a set with many pairs is spread over tasks. Only the pairs stay stored."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        of: dict[bytes, np.ndarray] = {}
        words: dict[bytes, set[bytes]] = {}

        def tokens(t: bytes) -> np.ndarray:
            if t not in of:
                of[t] = np.unique(shingles(Words([t], lower=True).hash, k))
            return of[t]

        def by_words(x: bytes, y: bytes) -> bool:
            for t in (x, y):
                if t not in words:
                    words[t] = word_shingles(t, k)
            both = len(words[x] & words[y])
            return 100 * both >= percent * (len(words[x]) + len(words[y]) - both)

        same = [alike(tokens(x), tokens(y), percent) and by_words(x, y) for x, y in zip(raw(batch.column(2)), raw(batch.column(3)), strict=True)]
        return pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    kind = left.schema["a"].dataType.simpleString()
    with workspace(left.sparkSession):
        involved = stored(left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct())
        texts = stored(docs.select("id", "text").join(maybe_broadcast(involved), "id", "left_semi"))
        text = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text"))
        wide = text("a").join(maybe_broadcast(left), "a").join(text("b"), "b").select("a", "b", "a_text", "b_text")
        return stored(by_batch(wide, step, f"a {kind}, b {kind}").distinct(), outside=True)


#: Members of a list with which all others are compared at first, and how many times as many each time it is still open.
HUBS, MORE = 4, 4


def _hubs(lists: DataFrame, hubs: int) -> DataFrame:
    """(key, hub, hub_n, hub_group, and the hub's bounds, if lists have them): so many members of each list, the first by hash of the id, so that lists of the same members have the same hubs. Cut before the shuffle."""
    first = lists.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("id"), "id", "n"))).where(F.col("place") <= hubs)
    return first.select("key", F.col("id").alias("hub"), *(F.col(c).alias(f"hub_{c}") for c in ("n", "group", *_bounds(lists))))


def _bounds(lists: DataFrame) -> list[str]:
    """The columns of lists of differences that bound what two members share of them."""
    return [c for c in ("over", "common") if c in lists.columns]


def _met(lists: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs of each list's members with its hubs of other components, if their sizes, and the bounds of their differences, allow a link."""
    allowed = (F.col("group") != F.col("hub_group")) & _sizes_allow("n", "hub_n", percent)
    if _bounds(lists):
        allowed &= F.col("over") + F.col("hub_over") <= 2 * (100 + percent) * F.least("common", "hub_common")
    met = lists.join(hubs, "key").where(allowed)
    return met.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()


def _open(lists: DataFrame, labels: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """(key, id, n, bounds, group) of the lists that still have members of several components, hubs taken out, which have met all others."""
    own = ["key", "id", "n", *_bounds(lists)]
    left = lists.select(own)
    if hubs is not None:
        left = left.join(hubs.select("key", F.col("hub").alias("id")), ["key", "id"], "left_anti")
    labelled = left.join(maybe_broadcast(labels), "id", "left").select(*own, F.coalesce("component", "id").alias("group"))
    return _of_mixed(labelled)


def _listed(texts: DataFrame, k: int, percent: int, common: tuple[np.ndarray, np.ndarray], last: np.ndarray, kind: str) -> DataFrame:
    """(key, id, n) for each prefix token of each set under the first order, but that some tokens, given sorted, come last."""
    shared = texts.sparkSession.sparkContext.broadcast((common, last))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        common, last = shared.value
        keys, rows, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        texts = raw(batch.column(1))
        for a, b in chunks(texts):
            w = Words(texts[a:b], lower=True)
            owner, token, rare = chunk_sets(w, k, _rarity(w.hash, *common))
            n = np.bincount(owner, minlength=b - a)
            owner, token = prefixes(owner, token, np.where(_among(token, last), LAST, np.minimum(rare, LAST - 1)), percent)
            keys.append(token)
            rows.append(a + owner)
            sizes.append(n[owner])
        at = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(at), pa.array(np.concatenate(sizes))], ["key", "id", "n"])

    return by_batch(texts.select("id", "text"), step, f"key long, id {kind}, n long")


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def differing(token: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """The tokens that one of two sets of distinct tokens has and the other has not."""
    return np.setxor1d(token, pivot, assume_unique=True)


def _tokens(text: bytes, k: int) -> np.ndarray:
    return np.unique(shingles(Words([text], lower=True).hash, k))


def _lists_of(sets: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _apart(still: DataFrame, texts: DataFrame, k: int, percent: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """(key, id, n, over, common) lists and (a, b) pairs in which all members of a list of still that could link meet again, by their differences from a pivot.

    Lists that share members make up a cluster; its pivot is the set of the tokens that more than half of its members have. Where sets of n and m tokens differ from it in e and f of
    them, they differ from each other in e + f less twice what the differences share. Those that link differ in (n + m) * (100 - percent) / (100 + percent) tokens
    at most, so with over = (100 + percent) * e - (100 - percent) * n the differences share (over + other's over) / (2 * (100 + percent)) at least. Where that is not above 0, the
    two link for certain, and both with the set of the least over: these are the pairs. All others share a token of the prefixes of their differences, the rarest of the cluster first.
    Only common differences, those of several members, can be shared, so f is what the two share and the other's alone at least, which gives
    (over + (100 + percent) * alone - (100 - percent) * m) / (100 + percent) as a second bound. A member whose common differences are fewer than its bounds links with none and is in no list,
    and members of a list meet only if the common differences of both allow what that pair has to share.
    What most of a cluster have is in few differences, so texts made from one by many changes of their own share few lists, and those far from it, which only lack the same tokens, none.
    """
    near = still.join(still.groupBy("key").agg(F.min("id").alias("b")), "key").select(F.col("id").alias("a"), "b").distinct()
    cluster = stored(components(stored(near)).withColumnRenamed("component", "cluster"))
    rows = texts.join(maybe_broadcast(cluster), "id").select("id", "digest", "cluster", "text")

    def all_tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [_tokens(t, k) for t in raw(batch.column(3))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], _lists_of(sets)], ["id", "digest", "cluster", "tokens"])

    sets = stored(by_batch(rows, all_tokens, f"id {kind}, digest binary, cluster {kind}, tokens array<long>"))
    half = stored(sets.groupBy("cluster").agg((F.count(F.lit(1)) / 2).alias("half")))
    held = sets.select("cluster", F.explode("tokens").alias("token")).groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("rows"))
    base = stored(held.join(maybe_broadcast(half), "cluster").where("rows > half").groupBy("cluster").agg(F.collect_list("token").alias("base")))
    both = sets.join(base, "cluster", "left").select("id", "digest", "cluster", F.xxhash64("cluster").alias("seed"), "tokens", "base")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, n = [], []
        for seed, own, base in zip(batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
            own, base = (np.zeros(0, np.uint64) if x.values is None else x.values.to_numpy().view(np.uint64) for x in (own, base))
            n.append(len(own))
            keys.append(mix(differing(own, base) + np.uint64(seed % (1 << 64))))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), _lists_of(keys)], ["id", "digest", "cluster", "n", "keys"])

    sets = by_batch(both, step, f"id {kind}, digest binary, cluster {kind}, n long, keys array<long>")
    sets = stored(sets.withColumn("over", (100 + percent) * F.size("keys").cast("long") - (100 - percent) * F.col("n")))
    # tokens of one set alone make no list
    each = sets.select("id", "digest", F.explode("keys").alias("key"))
    counts = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    each = stored(each.join(maybe_broadcast(counts), "key"))
    common = each.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("common"))
    sets = sets.select("id", "digest", "cluster", "n", "over", F.size("keys").cast("long").alias("e")).distinct().join(common, ["id", "digest"], "left")
    sets = stored(sets.withColumn("common", F.coalesce("common", F.lit(0))).withColumn("alone", (100 + percent) * F.greatest(F.col("e") - F.col("common"), F.lit(0)) - (100 - percent) * F.col("n")))
    least = stored(sets.groupBy("cluster").agg(F.min(F.struct("over", "id")).alias("least"), F.min("alone").alias("least_alone")))
    sets = stored(sets.join(maybe_broadcast(least), "cluster").withColumn("sum", F.col("over") + F.col("least.over")))
    sure = sets.where("sum <= 0 and id <> least.id").select(F.greatest("id", "least.id").alias("a"), F.least("id", "least.id").alias("b")).distinct()
    share = F.greatest(F.lit(1), F.ceil(F.col("sum") / (2 * (100 + percent))), F.ceil((F.col("over") + F.col("least_alone")) / (100 + percent)))
    able = stored(sets.withColumn("share", share).where("common >= share").select("id", "digest", "n", "over", "common", "share"))
    own = Window.partitionBy("id", "digest")
    placed = each.join(maybe_broadcast(able), ["id", "digest"]).withColumn("place", F.row_number().over(own.orderBy("rows", "key")))
    return stored(placed.where("place <= common - share + 1").select("key", "id", "n", "over", "common")), stored(sure)


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The keys of more than one row."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)


def _mixed(lists: DataFrame) -> DataFrame:
    """The keys whose members are of several components; least and greatest are taken before the shuffle."""
    return lists.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("key")


#: Bits of the table that drops, before a shuffle, most rows whose key is not asked for.
BITS = 1 << 24


def _of_mixed(lists: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of the keys whose members are of several components. Most keys are of one row; where those asked for are too many to broadcast, bits of them drop most other rows before the shuffle."""
    with workspace(lists.sparkSession):
        keys = stored(_mixed(lists))
        n = keys.count()
        if n > most and n <= BITS:
            place = F.xxhash64("key").bitwiseAND(F.lit(BITS - 1))
            # of the low 24 bits of a hash 18 name a row of the table and 6 a bit in it
            row, bit = F.shiftright(place, 6).alias("row"), F.expr("shiftleft(1L, cast(xxhash64(key) & 63 as int))")
            bits = stored(keys.select(row, bit.alias("bit")).groupBy("row").agg(F.bit_or("bit").alias("bits")))
            lists = lists.withColumn("row", row).join(F.broadcast(bits), "row").where(F.col("bits").bitwiseAND(bit) != 0).drop("row", "bits")
        return stored(lists.join(F.broadcast(keys) if n <= most else keys, "key"), outside=True)


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, common_words: int = COMMON_WORDS) -> DataFrame:
    """One row for each row: doc_id, n_shingles, component_id (least id that links reach)."""
    with workspace(docs.sparkSession):
        return stored(_link(docs, id_col, text_col, words, percent, common_words), outside=True)


def _link(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, common_words: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # the least id of each text with words stands for its copies, and an id of several texts links them
    digest = F.when(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.unhex(F.sha2("text", 256))).alias("digest")
    members = stored(rows.select("id", digest))
    held = members.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    heads = stored(held.groupBy("digest").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("rows")))
    twice = held.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id")
    twice = stored(held.join(maybe_broadcast(stored(twice)), "id").join(heads, "digest").select("id", "head"))
    bonds = stored(twice.join(twice.groupBy("id").agg(F.min("head").alias("b")), "id").select(F.col("head").alias("a"), "b").where("a <> b").distinct())
    spare = stored(held.join(heads.where("rows > 1"), "digest").where("id <> head").select("id", "digest").distinct())
    texts = rows.select("id", "text", digest).where(F.col("id").isNotNull() & F.col("digest").isNotNull()).join(maybe_broadcast(spare), ["id", "digest"], "left_anti")

    common = _common_words(rows, common_words)
    sets = stored(_sets(texts, words, percent, common, kind))
    firsts = sets.select(F.explode("firsts").alias("key"), "id", "n")
    lists = stored(firsts.join(_several(firsts, "key"), "key").withColumn("group", F.col("id")))
    compared = stored(_met(lists, stored(_hubs(lists, HUBS)), percent))
    edges = stored(bonds.unionByName(_verified(stored(_possible(compared, sets, percent)), texts, words, percent)))
    labels = components(edges)

    def met(lists: DataFrame, hubs: DataFrame, sure: DataFrame | None = None) -> DataFrame:
        """Compares lists with their hubs, and the pairs that are sure to link; gives what is still open of the lists."""
        nonlocal compared, edges, labels
        pairs = _met(lists, hubs, percent)
        new = stored((pairs.unionByName(sure).distinct() if sure is not None else pairs).join(compared, ["a", "b"], "left_anti"))
        compared = compared.unionByName(new)
        more = _verified(stored(_possible(new, sets, percent)), texts, words, percent)
        if _some(more):
            edges = stored(edges.unionByName(more))
            labels = components(edges)
        return _open(lists, labels, hubs)

    labelled = sets.select("id", "n", "prefix").join(maybe_broadcast(labels), "id", "left")
    tokens = labelled.select(F.explode("prefix").alias("key"), "id", "n", F.coalesce("component", "id").alias("group"))
    lists = _of_mixed(tokens)
    # the tokens are not read again, and take as much room as the rest of the sets
    whole, sets = sets, stored(sets.drop("firsts", "prefix"))
    discard(whole)
    hubs = stored(_hubs(lists, HUBS))
    still = met(lists, hubs)
    number, round_ = HUBS * MORE, 0
    while _some(still):
        # members of lists that are still open, and they alone, meet: first under an order in which these lists' tokens come last, which
        # takes the least room, then by what they have and lack of a common set
        left = texts.join(maybe_broadcast(stored(still.select("id").distinct())), "id", "left_semi")
        if round_ == 0:
            last = _most_common(stored(still.groupBy("key").agg(F.count(F.lit(1)).alias("n"))), "key", LAST_TOKENS)[0]
            listed, sure = stored(_listed(left, words, percent, common, last, kind)), None
        else:
            listed, sure = _apart(still, left, words, percent, kind)
        lists = _open(listed, labels)
        discard(listed)
        still = met(lists, stored(_hubs(lists, number)), sure)
        number, round_ = number * MORE if round_ else number, round_ + 1
    of_text = heads.join(labels.withColumnRenamed("id", "head"), "head", "left").select("digest", F.coalesce("component", "head").alias("component"))
    told = members.where("digest is not null").join(sets.select("digest", "n").distinct(), "digest", "left").join(of_text, "digest", "left")
    told = told.select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    # a row without words has its id's other rows to link it, if any
    blank = members.where("digest is null").select("id")
    other = told.join(blank.distinct(), "id", "left_semi").groupBy("id").agg(F.min("component").alias("component"))
    empty = blank.join(other, "id", "left").select("id", F.lit(0).cast("long").alias("n"), F.coalesce("component", "id").alias("component"))
    return told.unionByName(empty).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of one document of each component, that of the least id, with all its columns. Rows with a null id all stay."""
    found = link(docs, id_col, text_col)
    extra = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct())
    left = docs.join(extra, docs[id_col] == extra["__id"], "left_anti")
    again = stored(docs.select(F.col(id_col).alias("__id")).where("__id is not null").groupBy("__id").count().where("count > 1").select("__id"))
    if not _some(again):
        return left
    same = left[id_col] == again["__id"]
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([id_col]))
