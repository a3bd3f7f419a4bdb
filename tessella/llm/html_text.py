"""Main text of web pages: a suffix array over each host's pages finds what they repeat, and markup hints at the rest.

The token streams of a host's pages are concatenated with a separate mark after each page, and their
suffixes are sorted by prefix doubling as far as LONG tokens, which tells on how many distinct pages each substring of that length
occurs. Substrings on at least half of the pages, and no fewer than MOST_PAGES, cover boilerplate: a block that they cover goes
wherever it stands, inside an article too, but for pages that would be left without any block. Substrings that two pages share cover what may be
boilerplate: it goes where markup says nothing, that is outside article and main elements, on pages that have none.
Markup decides what no substring covers: blocks inside article or main elements are kept, even where a few pages share them, and blocks
inside menus, headers, footers, sidebars, notices, adverts, forms and comments are dropped, even where they are unique.

The pages of a large host are dealt to groups of about GROUP_BYTES by hash, each with a suffix array of its own, and the result
does not depend on the groups: what is on half of a host's pages is on half of some group's, so each group names such substrings, whose pages
are then counted in all groups; and what open pages share with pages of other groups is counted over the whole host by 64-bit hashes of LONG
tokens. Hosts with either go through their groups once more. Pages of a group with equal token streams count as one page.

Null html and html without text give an empty text; a null url counts as a host of its own. Each row has its result, so rows that repeat an id, or a row, have
equal ones; an empty table gives no rows. Columns other than those named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_batch, grams, maybe_broadcast, stored
from .urls import host_of

LONG = 8
#: Bytes of html of one group, about.
GROUP_BYTES = 1 << 20
#: Least number of a host's pages that a substring is on to be boilerplate.
MOST_PAGES = 10
#: Pages of one task, about.
TASK_PAGES = 2000
#: Stands after each block; blocks are split at it, so no word has it.
_END = "\x1f"

_TOKEN = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template|svg|iframe|textarea|math|object|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_KEEP = frozenset(["article", "main"])
_DROP = frozenset("nav footer aside form menu dialog button fieldset".split())
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|menu|nav\w*|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|related|share|social|comments?|disqus|respond|login|search)(?:$|[\s_-])"
)

_REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|related|teaser)(?:$|[\s_-])")
#: Names of elements that hold main text whatever else they are called.
_BODY = re.compile(r"content|article|main|entry|story|body|wrap|container|layout|page")


def _dropped(tag: str, attributes: str, kept: bool) -> bool:
    """Whether an element's tag or names say that it holds no main text."""
    if tag in _DROP or tag == "header" and not kept:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    names = " ".join(m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)).lower()
    if tag in _KEEP:
        return bool(_REMARKS.search(names))
    return bool(_NAMES.search(names)) and not _BODY.search(names)


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(kind, text) of each block with text: kept, dropped or open."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # elements that settle a kind, and those nested in them that share their tags
    at = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((stack[-1][1] if stack else "open", text))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            if tag in _VOID or not m.group(4) and not any(t == tag for t, _ in stack):
                continue
        if not m.group(2) and tag in ("p", "li") and stack and stack[-1][0] == tag:
            close()  # its end may be left out
            stack.pop()
        now = stack[-1][1] if stack else "open"
        if m.group(2):
            if tag not in _INLINE:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close()
                    del stack[k:]
                    break
            continue
        if now != "dropped" and tag not in _VOID and _dropped(tag, m.group(4), now == "kept"):
            close()
            stack.append((tag, "dropped"))
        elif tag in _KEEP and not _dropped(tag, m.group(4), False) and (now != "dropped" or not any(t in _KEEP for t, _ in stack)):
            close()
            stack.append((tag, "kept"))
        else:
            if tag not in _INLINE:
                close()
            if tag not in _VOID and any(t == tag for t, _ in stack):
                stack.append((tag, now))
    parts.append(page[at:])
    close()
    return out


def pages_with(streams: list[list[int]], long: int = LONG) -> tuple[list[np.ndarray], int]:
    """For each place of each stream, how many distinct streams have the substring of so many tokens that begins there, 0 where none does; and the number of distinct streams."""
    first: dict[tuple[int, ...], int] = {}
    who = [first.setdefault(tuple(s), i) for i, s in enumerate(streams)]
    n = sum(map(len, streams)) + len(streams)
    rank, page = np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts, at = [], 0
    top = max((max(s, default=0) for s in streams), default=0)
    for i, s in enumerate(streams):
        starts.append(at)
        rank[at : at + len(s)] = s
        page[at : at + len(s) + 1] = who[i]
        at += len(s)
        rank[at] = top + 1 + i  # a mark that no other page has
        at += 1
    have = 1
    while have < long and n:
        step = min(have, long - have)
        after = np.full(n, -1, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (np.int64(n) + top + len(streams) + 2) + after + 1, return_inverse=True)[1]
        top, have = int(rank.max()), have + step
    found = np.zeros(n, np.int64)
    if n >= long:
        order = np.lexsort((page[: n - long + 1], rank[: n - long + 1]))
        new = np.diff(rank[order], prepend=-1) != 0
        other = new | (np.diff(page[order], prepend=-1) != 0)
        edge = np.flatnonzero(new)
        found[order] = np.repeat(np.add.reduceat(other.astype(np.int64), edge), np.diff(np.append(edge, len(order))))
    out = []
    for a, s in zip(starts, streams, strict=True):
        one = found[a : a + len(s)].copy()
        one[max(len(s) - long + 1, 0) :] = 0
        out.append(one)
    return out, len(first)


def covered(places: np.ndarray, size: int, long: int = LONG) -> np.ndarray:
    """Which of so many tokens lie in a substring that begins at one of the places."""
    steps = np.zeros(size + long + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + long, -1)
    return np.cumsum(steps)[:size] > 0


def _unique(words: list[str], inside: np.ndarray, long: int) -> str:
    """Words outside covered runs. A short run that ends within the block comes from what stands beside the block, and stays."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    gone = {i for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= long or b - a == len(words) for i in range(a, b)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _windows(blocks: list[tuple[str, str]], long: int) -> tuple[np.ndarray, int]:
    """Hashes of each so many consecutive tokens of a page, and one of its whole token stream."""
    stream = "".join(f"{text} {_END} " for _, text in blocks).encode("utf-8", "surrogatepass")
    return grams(Words([stream]).hash, long), int.from_bytes(hashlib.blake2b(stream, digest_size=8).digest(), "little", signed=True)


def _settled(blocks: list[tuple[str, str]]) -> bool:
    return any(kind == "kept" for kind, _ in blocks)


def packed(blocks: list[tuple[str, str]]) -> bytes:
    """A page's blocks for the shuffle. Compressed, as Spark's own compression of shuffles leaves half as much again."""
    return zlib.compress("".join(kind[0] + text + _END for kind, text in blocks).encode("utf-8", "surrogatepass"))


_KINDS = {"k": "kept", "d": "dropped", "o": "open"}


def unpacked(page: bytes) -> list[tuple[str, str]]:
    return [(_KINDS[x[0]], x[1:]) for x in zlib.decompress(page).decode("utf-8", "surrogatepass").split(_END)[:-1]]


def texts_of(parsed: list[list[tuple[str, str]]], long: int = LONG, elsewhere: np.ndarray | None = None, boiler: np.ndarray | None = None) -> tuple[list[tuple[str, int]], np.ndarray]:
    """From the blocks of pages: main text of each, and how many of its tokens other pages repeat. Then hashes of the windows that are on half of the pages given and reach into what markup keeps.

    elsewhere has hashes of windows that pages which are not given here share with those given, or among each other; boiler has those of windows on half
    of the host's pages, which the pages given tell themselves if they are all.
    """
    number: dict[str, int] = {"\n": 0}
    streams = []
    for blocks in parsed:
        stream: list[int] = []
        for _, text in blocks:
            stream += [number.setdefault(w, len(number)) for w in text.split(" ")]
            stream.append(0)
        streams.append(stream)
    counts, pages = pages_with(streams, long)
    out, heavy = [], [np.zeros(0, np.uint64)]
    for blocks, n in zip(parsed, counts, strict=True):
        most = np.flatnonzero(2 * n >= max(pages, 2))
        # only those that reach into a kept block can take one
        held = np.concatenate([[0], np.cumsum(np.repeat([k == "kept" for k, _ in blocks], [len(t.split(" ")) + 1 for _, t in blocks]))]) if blocks else np.zeros(1, np.int64)
        reach = most[held[np.minimum(most + long, len(n))] > held[most]]
        if len(reach):
            heavy.append(np.unique(_windows(blocks, long)[0][reach]))
        if boiler is None:
            most = most[n[most] >= MOST_PAGES]
        inside = covered(np.flatnonzero(n > 1), len(n), long)
        if boiler is not None and len(boiler) or elsewhere is not None and len(elsewhere):
            hashes = _windows(blocks, long)[0]
            if elsewhere is not None:
                inside |= covered(np.flatnonzero(np.isin(hashes, elsewhere)), len(n), long)
            if boiler is not None:
                most = np.flatnonzero(np.isin(hashes, boiler))
        elif boiler is not None:
            most = most[:0]
        gone = covered(most, len(n), long)
        kept, whole, at = [], [], 0
        settled = _settled(blocks)
        for kind, text in blocks:
            words = text.split(" ")
            if kind == "kept":
                whole.append(text)
                if not gone[at : at + len(words)].all():
                    kept.append(text)
            elif kind == "open" and not settled:
                unique = _unique(words, inside[at : at + len(words)], long)
                if unique:
                    kept.append(unique)
            at += len(words) + 1
        out.append(("\n".join(kept or whole), int(inside.sum())))  # what is all there is is no boilerplate
    return out, np.unique(np.concatenate(heavy))


def _parsed(pages: DataFrame, kind: str) -> DataFrame:
    """page_id, url, host, part, several, blocks (packed): html is parsed before it is dealt to groups."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        blocks = pa.array([packed(blocks_of(x or "")) for x in batch.column(5).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:5], blocks], ["page_id", "url", "host", "part", "several", "blocks"])

    return by_batch(pages.select("page_id", "url", "host", "part", "several", "html"), step, f"page_id {kind}, url string, host string, part long, several boolean, blocks binary")


def _windows_of(pages: DataFrame, counted: bool, only_asking: bool) -> DataFrame:
    """Each page's windows. Those of pages that the markup settles ask for repeats only if these are counted."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, windows, streams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, page in enumerate(batch.column(2).to_pylist()):
            blocks = unpacked(page)
            if not only_asking or counted or not _settled(blocks):
                found, stream = _windows(blocks, LONG)
                windows.append(np.unique(found))
                n = len(windows[-1])
                rows.append(np.full(n, i))
                streams.append(np.full(n, stream, np.int64))
        at = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(windows).view(np.int64)), pa.array(np.concatenate(streams))], ["host", "part", "window", "stream"])

    return by_batch(pages.select("host", "part", "blocks"), step, "host string, part long, window long, stream long")


def _shared(pages: DataFrame, counted: bool) -> DataFrame:
    """host, part, window: the windows that different pages of a host have, for each part that asks for them."""
    windows, asking = _windows_of(pages, counted, False), _windows_of(pages, counted, True)
    if not counted:
        asked = stored(asking.select("host", "window").distinct())
        windows = windows.join(maybe_broadcast(asked), ["host", "window"], "left_semi")
    repeats = stored(windows.groupBy("host", "window").agg(F.min("stream").alias("lo"), F.max("stream").alias("hi")).where("lo != hi").select("host", "window"))
    return stored(asking.select("host", "part", "window").distinct().join(maybe_broadcast(repeats), ["host", "window"], "left_semi"))


def _boilerplate(parsed: DataFrame, named: DataFrame, parts: DataFrame, groups: DataFrame, tasks: int) -> DataFrame:
    """host, part, window: of the windows that some group of a host names, those on half of its pages, for each of its parts."""

    def count(t: pa.Table, asked: pa.Table) -> pa.Table:
        known = asked["window"].to_numpy().view(np.uint64)
        found = [np.zeros(0, np.uint64)]
        for page in dict.fromkeys(t["blocks"].to_pylist()):
            hashes = np.unique(_windows(unpacked(page), LONG)[0])
            found.append(hashes[np.isin(hashes, known)])
        windows, n = np.unique(np.concatenate(found), return_counts=True)
        host = t["host"][0].as_py() if t.num_rows else None
        return pa.table({"host": pa.array([host] * len(windows), pa.string()), "window": pa.array(windows.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    each = stored(named.distinct().join(maybe_broadcast(parts), "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "window"))
    pages = parsed.join(maybe_broadcast(named.select("host").distinct()), "host", "left_semi")
    dealt = [df.repartition(tasks, "host", "part").groupBy("host", "part") for df in (pages.select("host", "part", "blocks"), each)]
    counted = dealt[0].cogroup(dealt[1]).applyInArrow(count, "host string, window long, n long").groupBy("host", "window").agg(F.sum("n").alias("n"))
    totals = groups.groupBy("host").agg(F.sum("pages").alias("pages"))
    most = stored(counted.join(totals, "host").where((2 * F.col("n") >= F.col("pages")) & (F.col("n") >= MOST_PAGES)).select("host", "window"))
    return each.join(maybe_broadcast(most), ["host", "window"], "left_semi")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_bytes: int = GROUP_BYTES, counted: bool = True) -> DataFrame:
    """One row for each row: page_id, url, text, n_chars and, if counted, n_repeated (tokens that other pages of the host repeat)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.concat(F.lit("//"), host_of(F.col("url")), F.when(F.col("url").isNull(), "?").otherwise("")), F.lit("")))
    counts = stored(rows.groupBy("host").agg(F.count(F.lit(1)).alias("count"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).alias("bytes")))
    parts = counts.where(F.col("bytes") > group_bytes).select("host", F.ceil(F.col("bytes") / group_bytes).cast("long").alias("parts"))
    # as many tasks as the pages ask for, whatever the session's number of shuffle partitions
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(counts.agg(F.sum("count")).first()[0] or 0) // TASK_PAGES))
    kind = pages.schema[id_col].dataType.simpleString()
    split = rows.join(maybe_broadcast(parts), "host", "left").withColumn("several", F.col("parts").isNotNull())
    split = split.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))))
    parsed = _parsed(split, kind)
    columns = "page_id, url, text, n_chars".split(", ") + (["n_repeated"] if counted else [])
    told = f"page_id {kind}, url string, text string, n_chars long, n_repeated long, host string, several boolean, pages long, heavy array<long>, open boolean"

    def one(t: pa.Table, known: pa.Table | None = None) -> pa.Table:
        """A group's pages. The first row tells, of a group of several, its number of distinct pages, the windows on half of them, and whether it has open pages."""
        order = np.lexsort(([x or "" for x in t["url"].to_pylist()], [str(x) for x in t["page_id"].to_pylist()]))
        t = t.take(pa.array(order))
        several = bool(len(t)) and t["several"][0].as_py()
        blocks = [unpacked(x) for x in t["blocks"].to_pylist()]
        if known is None:
            found, heavy = texts_of(blocks, boiler=np.zeros(0, np.uint64) if several else None)
        else:
            window, boiler = known["window"].to_numpy().view(np.uint64), known["boiler"].to_numpy(zero_copy_only=False)
            found, heavy = texts_of(blocks, elsewhere=window[~boiler], boiler=window[boiler])
        first = [several] + [False] * (len(t) - 1) if len(t) else []
        tell = lambda value, k: pa.array([value if x else None for x in first], k)
        return pa.table(
            {
                "page_id": t["page_id"],
                "url": t["url"],
                "text": pa.array([x for x, _ in found], pa.string()),
                "n_chars": pa.array([len(x) for x, _ in found], pa.int64()),
                "n_repeated": pa.array([n for _, n in found], pa.int64()),
                "host": t["host"],
                "several": t["several"],
                "pages": tell(len(set(t["blocks"].to_pylist())), pa.int64()),
                "heavy": tell(heavy.view(np.int64).tolist(), pa.list_(pa.int64())),
                "open": tell(any(not _settled(b) for b in blocks), pa.bool_()),
            }
        )

    wanted = ("page_id", "url", "host", "part", "several", "blocks")
    dealt = parsed.select(*wanted).repartition(tasks, "host", "part").groupBy("host", "part")
    if not parts.limit(1).count():
        return dealt.applyInArrow(lambda t: one(t), told).select(*columns)
    out = stored(dealt.applyInArrow(lambda t: one(t), told), compression="zstd")  # written while the shuffle is still there
    groups = stored(out.where("pages is not null").select("host", "pages", "heavy", "open"))
    named = stored(groups.select("host", F.explode("heavy").alias("window")).distinct())
    asking = stored(groups.where(F.lit(counted) | F.col("open")).select("host").distinct())
    again = stored(named.select("host").unionByName(asking).distinct())
    if not again.limit(1).count():
        return out.select(*columns)
    # hosts of several groups in which a group names boilerplate, or has pages that what other groups repeat matters for
    known = _boilerplate(parsed.where("several"), named, parts, groups, tasks).select("host", "part", "window", F.lit(True).alias("boiler"))
    asked = parsed.where("several").join(maybe_broadcast(asking), "host", "left_semi")
    known = stored(known.unionByName(_shared(asked, counted).select("host", "part", "window", F.lit(False).alias("boiler"))))
    redone = parsed.where("several").join(maybe_broadcast(again), "host", "left_semi")
    both = [df.repartition(tasks, "host", "part").groupBy("host", "part") for df in (redone.select(*wanted), known)]
    final = both[0].cogroup(both[1]).applyInArrow(one, told)
    return out.join(maybe_broadcast(again), "host", "left_anti").select(*columns).unionByName(final.select(*columns))
