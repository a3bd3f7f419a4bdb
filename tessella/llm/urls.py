"""URL filters: rules, then naive Bayes over words that a unigram Viterbi search finds in hosts and paths.

A host's labels and a path's parts are cut at marks and digits; each remaining run of letters is
split into the likeliest sequence of lexicon words, with letters outside any word kept together
as unknown runs. The lexicon's unigram model is fitted on the words of a table's texts, counted over all of them; words of the labelled samples
are always in it. Multinomial naive Bayes scores the words, trained from labelled addresses: names made of
two bounded word lists, of words of unwanted and of ordinary sites, and ordinary names made of the lexicon itself.

Null addresses and those without ``://`` have an empty host and path, fit no rule and are allowed, as are addresses that no
word speaks for or against (score 0 or less). Each row is judged by itself, so rows that repeat an id, or a row, each have their
result; an empty table gives no rows. Columns other than the id and the address are not read, whatever their names.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, commonest, stored

#: Rules of the query: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Words of unwanted and of ordinary addresses, commonest first, for the built-in lexicon and samples.
UNWANTED = (
    "spam ads adserver tracker track popup adult porn xxx sex casino poker slots bet bets betting gambling viagra pills pharmacy cheap loans payday crack warez torrent keygen malware phishing hack cheats escort dating nude cam webcam farm clickbait scam fake replica bitcoin doubler lottery jackpot"
).split()
ORDINARY = (
    "news blog shop store home page en de fr es www mail docs help support forum wiki data science school health travel music sports weather food recipes garden art books library history culture world local city media press office cloud code dev open source project research journal review guide learn course example html index article post archive photo video map event team about contact"
).split()


_UNWANTED = frozenset(UNWANTED)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Segmenter:
    """Unigram model: log-probabilities of words; a letter outside any word costs unknown."""

    lexicon: dict[str, float]
    unknown: float = math.log(1e-4)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.lexicon), default=1)

    @classmethod
    def of(cls, counts: Mapping[str, float]) -> Segmenter:
        total = sum(counts.values())
        return cls({w: math.log(n / total) for w, n in counts.items()})

    def split(self, run: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            score, start = best[end - 1] + self.unknown, end - 1
            for k in range(2, min(self.longest, end) + 1):
                word = self.lexicon.get(run[end - k : end])
                if word is not None and best[end - k] + word > score:
                    score, start = best[end - k] + word, end - k
            best.append(score)
            back.append(start)
        out: list[str] = []
        loose = False
        end = len(run)
        while end:
            piece = run[back[end] : end]
            known = len(piece) > 1
            if not known and loose:
                out[-1] = piece + out[-1]
            else:
                out.append(piece)
            loose, end = not known, back[end]
        return out[::-1]


_RUNS = re.compile(r"[^\W\d_]+")


@dataclass
class UrlModel:
    segmenter: Segmenter
    weight: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0

    def tokens(self, host: str, path: str) -> list[str]:
        return [w for text in (host, path) for run in _RUNS.findall(text.lower()) for w in self.segmenter.split(run)]

    def score(self, host: str, path: str) -> float:
        """Log-odds of blocking; words that no sample has say nothing."""
        return self.prior + sum(self.weight.get(w, 0.0) for w in self.tokens(host, path))

    def verdict(self, host: str, path: str) -> str:
        return "block" if self.score(host, path) > 0 else "allow"


def labelled_urls(n: int = 2000, seed: int = 11, words: Sequence[str] = ()) -> list[tuple[str, str, bool]]:
    """Samples (host, path, unwanted): a fifth unwanted, with words of the lists run together or apart; of the others, half have names of the words given."""
    rng = random.Random(seed)
    out, plain = [], [w for w in words if w not in _UNWANTED]
    for i in range(n):
        bad = i % 5 == 0
        of = UNWANTED if bad else plain if plain and i % 2 else ORDINARY
        names = rng.choices(of, k=rng.randint(1, 2)) + (rng.choices(ORDINARY, k=1) if rng.random() < 0.3 else [])
        rng.shuffle(names)
        host = rng.choice(["", "www.", "m.", "blog."]) + rng.choice(["", "-"]).join(names) + rng.choice([".com", ".net", ".org", ".example.com"])
        out.append((host, "/" + "/".join(rng.choices(ORDINARY, k=rng.randint(0, 3))) + f"/{rng.randint(1, 9999)}", bad))
    return out


def train(samples: list[tuple[str, str, bool]], segmenter: Segmenter, smoothing: float = 1.0) -> UrlModel:
    model = UrlModel(segmenter)
    counts = {True: Counter(), False: Counter()}
    rows = Counter(bad for *_, bad in samples)
    for host, path, bad in samples:
        counts[bad].update(model.tokens(host, path))
    words = counts[True] | counts[False]
    total = {k: sum(c.values()) + smoothing * len(words) for k, c in counts.items()}
    model.weight = {w: math.log((counts[True][w] + smoothing) / total[True]) - math.log((counts[False][w] + smoothing) / total[False]) for w in words}
    model.prior = math.log((rows[True] + 1) / (rows[False] + 1))
    return model


#: Most words of the lexicon that come from texts, and letters of a word.
LEXICON, LETTERS = 50_000, 24
#: Share of all words that a word of the lists counts for at least; so much that three common short words do not make it up.
LISTED = 1e-3


def lexicon(words: Mapping[str, float]) -> dict[str, float]:
    """Counts of words of three letters at least, and of those listed."""
    counts = {w: float(n) for w, n in words.items() if len(w) > 2}
    least = max(sum(counts.values()) * LISTED, 1.0)
    return counts | {w: max(counts.get(w, 0.0), least) for w in (*UNWANTED, *ORDINARY)}


def built_in(words: Mapping[str, float] | None = None) -> UrlModel:
    """A model from counts of words, of none but the lists' unless given."""
    counts = lexicon(words or {})
    return train(labelled_urls(words=sorted(words or {}, key=lambda w: (-words[w], w))[:2000]), Segmenter.of(counts))


def word_counts(df: DataFrame, text_col: str = "text", most: int = LEXICON) -> dict[str, int]:
    """The commonest runs of ASCII letters of all whole texts, lower-cased, and how often each occurs, twice at least; at most so many come to the driver."""
    each = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(r"(?<![\p{L}\p{N}])[a-z]{2,%d}(?![\p{L}\p{N}])" % LETTERS), F.lit(0)))
    counted = df.select(each.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in commonest(stored(counted.where("n > 1")), most).collect()}


def fit(texts: DataFrame, text_col: str = "text") -> UrlModel:
    """A model whose lexicon is fitted on all texts."""
    return built_in(word_counts(texts, text_col))


def judge(df: DataFrame, model: UrlModel, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row: id, host, path, rule, verdict, score (log-odds of blocking). Other columns are left out."""
    kind = df.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")
    picked = df.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = picked.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))

    shared = df.sparkSession.sparkContext.broadcast(model)  # of a bounded lexicon

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        scores = [model.score(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        verdicts = [r or ("block" if s > 0 else "allow") for r, s in zip(batch.column(4).to_pylist(), scores, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], ["id", "host", "path", "rule", "verdict", "score"])

    return by_batch(ruled, step, f"id {kind}, host string, path string, rule string, verdict string, score double")
