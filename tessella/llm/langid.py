"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Features are the character bigrams and trigrams of letters, lower-cased one character at a time,
with any other character read as one gap. Embeddings and softmax are trained by stochastic gradient
descent in numpy on a bounded sample of labelled texts. The softmax has one more class for texts of no
learned language; its samples are made of the others, by shuffled letters and by random features. A temperature
and a rejection threshold are fitted on labelled texts that training leaves out, and on such samples of
them. As the softmax is linear in the average, prediction sums one precomputed row of scores per feature.

The score is the probability of the best language, so all languages may score low, even where only one
is learned. Null text and text without letters is ``und`` with score 0 and is rejected. Of languages with equal scores the first by name is
predicted. Each row is judged by its own text, so rows that repeat an id, or a row, each have their result; an empty table gives no rows, and where nothing can be learned
all is ``und``. Columns other than those named are not read, whatever their names; accepted() passes them on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, sampled

BITS = 15
DIM = 16
#: Most labelled rows that are brought to the driver for training and calibration, and letters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
#: Most letters or features of a made sample of no language.
SALAD = 400

_tables: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, or 32 where it is no letter."""
    if not _tables:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables.append(table)
    return _tables[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, and where those of each text begin (one more entry than texts)."""
    joined = "  ".join(["", *texts, ""])
    codes = _lower_letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    with np.errstate(over="ignore"):
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        two = (a * np.uint32(0x9E3779B1) + b) * np.uint32(0x85EBCA6B)
        three = (two ^ c) * np.uint32(0xC2B2AE35)
        two = (two ^ (two >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BITS)
    # two covers a and b, three adds c; a feature counts where b is a letter
    keep = np.flatnonzero(b != 32)
    found = np.empty((len(keep), 2), np.uint32)
    found[:, 0], found[:, 1] = two[keep] >> shift, three[keep] >> shift
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])]) if texts else np.zeros(1, int)
    return found.reshape(-1), 2 * np.searchsorted(keep, starts)


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all languages, then of none of them, and the number of features, of each text."""
        out, n = np.zeros((len(texts), len(self.bias))), np.zeros(len(texts), int)
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 18):
                size += len(texts[end])
                end += 1
            found, starts = features(texts[at:end])
            n[at:end] = np.diff(starts)
            for k in range(len(self.bias)):
                run = np.concatenate([[0.0], np.cumsum(self.table[k][found], dtype=np.float64)])
                out[at:end, k] = run[starts[1:]] - run[starts[:-1]]
            at = end
        return out / np.maximum(n, 1)[:, None] + self.bias, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and rejections."""
        logits, n = self.logits([t or "" for t in texts])
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        p = _softmax(logits / self.temperature)
        best = p[:, : len(self.langs)].argmax(1)
        score = np.where(n > 0, p[np.arange(len(texts)), best], 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, n, strict=True)], score, (n == 0) | (score < self.threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _salad(text: str, rng: np.random.Generator) -> str:
    """The letters of a text's start in random order, its gaps where they were."""
    start = np.array(list(text[:SALAD]))
    letters = np.flatnonzero([c.isalpha() for c in start])
    start[letters] = start[rng.permutation(letters)]
    return "".join(start)


def _bag(found: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray, int]:
    bucket, count = np.unique(found, return_counts=True)
    return bucket, (count / len(found)).astype(np.float32), y


def train(texts: list[str], langs: list[str], calibration: list[bool], epochs: int = 6, rate: float = 0.5, seed: int = 3) -> LangModel:
    """Fits on the texts not kept for calibration, then fits temperature and threshold on those kept. Texts without letters are passed over."""
    names = sorted(set(langs))
    if not names:
        return LangModel([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    of = {x: i for i, x in enumerate(names)}
    rng = np.random.default_rng(seed)
    rows = []
    for text, lang, held in zip(texts, langs, calibration, strict=True):
        found, _ = features([text])
        if len(found) and not held:
            rows.append(_bag(found, of[lang]))
            made = features([_salad(text, rng)])[0] if len(rows) % 4 else rng.integers(0, 1 << BITS, min(len(found), SALAD))
            rows.append(_bag(made if len(made) else found, len(names)))
    embed = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    soft, bias = np.zeros((len(names) + 1, DIM), np.float32), np.zeros(len(names) + 1, np.float32)
    total = epochs * max(len(rows), 1)
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, share, y = rows[i]
            now = rate * (1 - step / total)
            part = embed[bucket]
            mean = share @ part
            p = _softmax((soft @ mean + bias)[None])[0]
            p[y] -= 1
            back = p @ soft
            soft -= now * np.outer(p, mean)
            bias -= now * 0.1 * p
            embed[bucket] = part - (now * 20 * share[:, None]) * back[None]
            step += 1
    model = LangModel(names, np.ascontiguousarray((embed @ soft.T).T.astype(np.float32)), bias.astype(np.float64))
    kept = [(t, of[x]) for t, x, held in zip(texts, langs, calibration, strict=True) if held]
    if kept:
        _calibrate(model, [t for t, _ in kept], np.array([y for _, y in kept]))
    return model


def _calibrate(model: LangModel, texts: list[str], truth: np.ndarray) -> None:
    rng = np.random.default_rng(5)
    none = len(model.langs)
    logits, n = model.logits(texts + [_salad(t, rng) for t in texts])
    logits, truth = logits[n > 0], np.concatenate([truth, np.full(len(texts), none)])[n > 0]
    own = truth != none
    if not own.any():
        return
    # as in Platt's scaling, targets stop short of 1 by what so few texts can tell; scores do not all become 1
    sure = 1 - 1 / (len(truth) + 2)
    target = np.full(logits.shape, (1 - sure) / none)
    target[np.arange(len(truth)), truth] = sure
    loss = lambda t: -(target * np.log(np.maximum(_softmax(logits / t), 1e-300))).sum(1).mean()
    model.temperature = float(min(np.geomspace(0.02, 20, 61), key=loss))
    p = _softmax(logits / model.temperature)[:, :none]
    score = p.max(1)
    right = score[own & (p.argmax(1) == truth)]
    if len(right) and not own.all():
        model.threshold = max(_cut(right, score[~own]), 0.5)  # below, no language is more likely than not


def _cut(right: np.ndarray, none: np.ndarray) -> float:
    """Where the shares of texts rejected wrongly and accepted wrongly add up to least, but for two texts that may be odd; the middle, in log-odds, of the widest such gap."""
    both = np.clip(np.concatenate([right, none]), 1e-12, 1 - 1e-12)
    ends = np.unique(np.log(both) - np.log1p(-both))
    at = np.concatenate([ends[:1] - 1, (ends[1:] + ends[:-1]) / 2])
    wide = np.concatenate([[0.0], np.diff(ends)])
    cuts = 1 / (1 + np.exp(-at))
    wrong = np.searchsorted(np.sort(right), cuts) / len(right) + 1 - np.searchsorted(np.sort(none), cuts) / len(none)
    best = np.flatnonzero(wrong <= wrong.min() + 2 / min(len(right), len(none)))
    return float(cuts[best[wide[best].argmax()]])


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LangModel:
    """Learns from at most sample_rows labelled rows of remainders 0, 1 and 3, and SAMPLE_CHARS of each; a tenth of them calibrates.

    The sample is chosen by hashes of id, text and language, so it is the same on every run; rows that repeat all three count once.
    """
    row = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    learnable = row.where((remainder(F.col("id")) != 2) & F.col("lang").isNotNull())
    sized = learnable.where(F.col("text").isNotNull()).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), "lang", F.xxhash64(F.col("id").cast("string"), "text", "lang").alias("rank"))
    got = sampled(sized, sample_rows).collect()
    return train([r["text"] for r in got], [r["lang"] for r in got], [i % 10 == 9 for i in range(len(got))])


def identify(df: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, lang_pred, score, rejected. Other columns are left out."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, score, out = shared.value.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    return by_batch(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), step, f"id {kind}, lang_pred string, score double, rejected boolean")


def accepted(df: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return batch.filter(pa.array(~shared.value.predict(texts)[2]))

    return by_batch(df, step, df.schema)
