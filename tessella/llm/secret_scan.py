"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Two second-order character models are trained from labelled samples: random strings (keys, digests,
tokens) and ordinary identifiers (words, joined words, paths, addresses), the latter made of a built-in list and of words of
the documents themselves, as the patterns leave them (see words_of()). A run of key characters, or
what the patterns leave of it, is reported where the mean log-likelihood ratio of its characters exceeds
a threshold, which lies midway between held-out samples of both kinds; if it does not as a whole, its parts between / = - _ are judged,
neighbouring random ones together. Nothing but the ratio decides.

Spans count code points, end exclusive. Null text counts as empty and has no spans; an empty table gives no rows. Spans of the
patterns may overlap each other; those of the models (kind ``random``) overlap none of them. Of spans that begin together, the patterns' come
in the order of their kinds. Each row is judged by its own text, so rows that repeat an id, or a row, each have their result. Columns other than the
id and the text are not read, whatever their names; redact() passes them on.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, sampled

#: Kinds in their order; the patterns and least lengths are fixed values.
PATTERNS = {
    "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: Least length of a run that the models judge.
LEAST_RANDOM = 20
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RANDOM)
_PART = re.compile(r"[A-Za-z0-9+]+")
#: What RE2 finds in any text that has a span of any kind.
_ANY = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "random": r"[A-Za-z0-9+/_=-]{%d}" % LEAST_RANDOM,
}
_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = {c: i + 1 for i, c in enumerate(_SYMBOLS)}
_N = len(_SYMBOLS) + 1
#: Parts of ordinary identifiers, for the built-in samples.
_PARTS = (
    "access account action active address admin agent alert amount analysis api app archive array asset async attribute audit auth average backend backup balance batch "
    "begin binary block body border branch bridge browser buffer build bundle button cache calendar call cancel category center change channel chart check class clean "
    "click client clock close cluster code collection color column command comment commit common compile component config connect container content context control "
    "convert copy core count country create credit current custom data database date debug default delete delivery deploy detail device digest direct disk display "
    "document domain download driver dynamic edit element email enable encode engine entry error event example exchange execute export factory feature field file filter "
    "find folder font format frame function gateway general global graph group handle hash header health height hidden history host image import index info input insert"
).split()


def labelled_samples(n: int = 4000, seed: int = 7) -> tuple[list[str], list[int]]:
    """Built-in samples: n random strings (1) of the usual alphabets and n ordinary identifiers (0)."""
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", _SYMBOLS[:62], _SYMBOLS[:64], _SYMBOLS[26:62], _SYMBOLS[:26] + "0123456789"]
    joins = ["_", "-", "/", ""]
    texts, labels = [], []
    for i in range(n):
        texts.append("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(LEAST_RANDOM, 64))))
        labels.append(1)
        words = rng.choices(_PARTS, k=rng.randint(3, 8))
        style = rng.randrange(4)
        words = [w.upper() for w in words] if style == 1 else [w.capitalize() for w in words] if style == 2 else words
        texts.append(rng.choice(joins).join(words) + (rng.choice(["", "_", "-"]) + str(rng.randint(0, 2100)) if rng.random() < 0.3 else ""))
        labels.append(0)
    return texts, labels


@dataclass
class MarkovPair:
    """ratio[a, b, c]: by how much c after ab speaks for a random string."""

    ratio: np.ndarray
    threshold: float

    def score(self, run: str) -> float:
        codes = np.array([0, 0, *(_CODE.get(c, 0) for c in run)])
        return float(self.ratio[codes[:-2], codes[1:-1], codes[2:]].mean()) if run else -np.inf

    def is_random(self, run: str) -> bool:
        return self.score(run) > self.threshold


def _log_model(texts: list[str]) -> np.ndarray:
    """Second-order log-probabilities, smoothed by the first order, and that by a uniform one."""
    triples, pairs = np.zeros((_N, _N, _N)), np.zeros((_N, _N))
    for t in texts:
        codes = np.array([0, 0, *(_CODE.get(c, 0) for c in t)])
        np.add.at(triples, (codes[:-2], codes[1:-1], codes[2:]), 1)
        np.add.at(pairs, (codes[1:-1], codes[2:]), 1)
    first = (pairs + 0.5 / _N * 4) / (pairs.sum(1, keepdims=True) + 2)
    return np.log((triples + 2 * first[None]) / (triples.sum(2, keepdims=True) + 2))


def train(texts: list[str], labels: list[int], quantile: float = 0.999) -> MarkovPair:
    """Fits both models on three quarters of the samples.

    Of the other samples, the threshold keeps this share of the ordinary ones below it; where that leaves room below the random ones (but for
    a hundredth of them), it lies midway.
    """
    held = [i % 8 >= 6 for i in range(len(texts))]
    part = lambda y, h: [t for t, l, x in zip(texts, labels, held, strict=True) if l == y and x == h]  # noqa: E731, E741
    pair = MarkovPair(_log_model(part(1, False)) - _log_model(part(0, False)), 0.0)
    ordinary, random_ = ([pair.score(t) for t in part(y, True)] for y in (0, 1))
    low = float(np.quantile(ordinary, quantile)) if ordinary else -np.inf
    high = float(np.quantile(random_, 0.01)) if random_ else np.inf
    pair.threshold = low if not low < high else (low + high) / 2 if np.isfinite([low, high]).all() else 0.0
    return pair


#: Bounds of the words that training takes from documents: texts, words of each, letters of each.
SAMPLE_TEXTS, SAMPLE_WORDS, SAMPLE_LETTERS = 2000, 300, 40


def words_of(df: DataFrame, text_col: str = "text", most: int = SAMPLE_TEXTS) -> list[list[str]]:
    """Runs of letters of some documents, outside what the patterns find, for samples of ordinary strings.

    Texts are chosen by hash, so the same on every run. At most the bounds above come to the driver.
    """
    text = F.col(text_col).cast("string")
    plain = text
    for kind, pattern in (("assign", PATTERNS["assign"][0].pattern.replace("(?ai)", "(?i)")), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]{16,}")):
        plain = F.regexp_replace(plain, pattern, " ")
    found = F.slice(F.regexp_extract_all(plain, F.lit(r"(?<![\p{L}0-9+/_=-])([A-Za-z]{2,%d})(?![\p{L}0-9+/_=-])" % SAMPLE_LETTERS), F.lit(1)), 1, SAMPLE_WORDS)
    hashed = df.where(text.isNotNull()).select(text.alias(text_col), F.xxhash64(text).alias("rank"))
    chosen = sampled(hashed, most).select(found.alias("words"))
    return [r["words"] for r in chosen.where(F.size("words") > 0).collect()]


def samples_with(words: list[list[str]], n: int = 4000, seed: int = 7) -> tuple[list[str], list[int]]:
    """The built-in samples, and as many ordinary strings again of neighbouring words, run together or joined by marks."""
    texts, labels = labelled_samples(n, seed)
    rng = random.Random(seed + 1)
    for _ in range(n if words else 0):
        of = rng.choice(words)
        at, length = rng.randrange(len(of)), rng.randint(LEAST_RANDOM, 64)
        join, style = rng.choice(["", "", "_", "-", "/"]), rng.choice([str, str.lower, str.upper, str.capitalize])
        made = ""
        for w in itertools.islice(itertools.cycle(of), at, at + 40):
            made += (join if made else "") + style(w)
            if len(made) >= length:
                break
        texts.append(made)
        labels.append(0)
    return texts, labels


def fit(df: DataFrame, text_col: str = "text") -> MarkovPair:
    """Models and threshold for a table."""
    return train(*samples_with(words_of(df, text_col)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for order, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def _left(start: int, end: int, base: list[tuple[int, int, str]], first: int) -> list[tuple[int, int]]:
    """What spans, sorted by start and from the first that may reach it, leave of a run."""
    out, at = [], start
    for a, b, _ in itertools.islice(base, first, None):
        if a >= end:
            break
        if b > at:
            out.append((at, max(a, at)))
            at = b
    out.append((min(at, end), end))
    return [(a, b) for a, b in out if b - a >= LEAST_RANDOM]


def _random_parts(text: str, start: int, end: int, pair: MarkovPair) -> list[tuple[int, int]]:
    """The stretch as a whole if that is random; else its random parts, neighbours as one where that is random too."""
    if pair.is_random(text[start:end]):
        return [(start, end)]
    out: list[tuple[int, int]] = []
    near: list[tuple[int, int]] = []

    def close() -> None:
        if near and near[-1][1] - near[0][0] >= LEAST_RANDOM and pair.is_random(text[near[0][0] : near[-1][1]]):
            out.append((near[0][0], near[-1][1]))
        else:
            out.extend((a, b) for a, b in near if b - a >= LEAST_RANDOM and pair.is_random(text[a:b]))
        near.clear()

    for m in _PART.finditer(text, start, end):
        if pair.score(m.group()) > pair.threshold:
            near.append(m.span())
        else:
            close()
    close()
    return out


def random_spans(text: str, base: list[tuple[int, int, str]], pair: MarkovPair) -> list[tuple[int, int, str]]:
    out, first = [], 0
    reach = np.maximum.accumulate([b for _, b, _ in base]) if base else ()
    for m in _RUN.finditer(text):
        while first < len(base) and reach[first] <= m.start():
            first += 1
        for a, b in _left(m.start(), m.end(), base, first):
            out += [(x, y, "random") for x, y in _random_parts(text, a, b, pair)]
    return out


def spans_of(text: str, pair: MarkovPair) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The patterns' spans, and all spans by start, then kind."""
    base = base_spans(text)
    order = [*PATTERNS, "random"]
    return base, sorted(base + random_spans(text, base, pair), key=lambda s: (s[0], order.index(s[2])))


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _suspects(texts: pa.Array) -> list[bool]:
    """Texts that may have a span: RE2 passes once over the whole column for each kind."""
    found = pc.match_substring_regex(texts, _ANY["assign"])
    for kind in ("access", "hex", "random"):
        found = pc.or_(found, pc.match_substring_regex(texts, _ANY[kind]))
    return [bool(x) for x in found.to_pylist()]


def scan(df: DataFrame, pair: MarkovPair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, spans and base_spans as arrays of (kind, start, end). Other columns are left out."""
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [spans_of(t, pair) if hit else ([], []) for t, hit in zip(batch.column(1).to_pylist(), _suspects(batch.column(1)), strict=True)]
        listed = [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in r[which]] for r in rows], span) for which in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *listed], ["id", "base_spans", "spans"])

    part = "array<struct<kind:string,start:bigint,end:bigint>>"
    return by_batch(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), step, f"id {kind}, base_spans {part}, spans {part}")


def redact(df: DataFrame, pair: MarkovPair, text_col: str = "text", mark: str = "[SECRET]", count_col: str | None = None) -> DataFrame:
    """The same rows and columns, each union of overlapping spans replaced by a mark; count_col, if given, gets the new length."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        texts = batch.column(at).to_pylist()
        for i, hit in enumerate(_suspects(batch.column(at))):
            if hit:
                texts[i] = masked(texts[i], spans_of(texts[i], pair)[1], mark)
        out = batch.set_column(at, text_col, pa.array(texts, batch.schema.field(at).type))
        if count_col in batch.schema.names:
            k = batch.schema.get_field_index(count_col)
            out = out.set_column(k, count_col, pc.utf8_length(out.column(at)).cast(batch.schema.field(k).type))
        return out

    return by_batch(df, step, df.schema)


def masked(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def digests(scanned: DataFrame) -> DataFrame:
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(F.col("id").alias("doc_id"), *map(count, PATTERNS), F.sha2(told("base_spans"), 256).alias("base_sha256"), told("spans").alias("spans"))


def digest_of(text: str, pair: MarkovPair) -> tuple[int, int, int, str, str]:
    """What digests() gives for one text, for tests."""
    base, both = spans_of(text, pair)
    return *(sum(k == kind for *_, k in base) for kind in PATTERNS), hashlib.sha256(_told(base).encode()).hexdigest(), _told(both)
