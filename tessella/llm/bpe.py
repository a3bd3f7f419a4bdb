"""Byte-level BPE encoding and decoding by monoid tree reduction.

A long text is cut in halves until the pieces are short; each piece is encoded alone, and
neighbours are joined by encoding again a window around the seam. The window grows until it
starts and ends at a *safe cut*, a space after a letter, digit or ASCII mark: no match of the
pattern contains such a place except at its ends, and no match's extent depends on what lies
beyond it. Tokens outside the window are then those of the whole text. Texts without safe cuts
are joined inside a single match instead, where a list of tokens is the encoding of its bytes if
each neighbouring pair is the encoding of the pair's own bytes; the window grows until the pairs
at both its ends are. Decoding concatenates the tokens' bytes up the same tree.

Null text counts as empty and gives no tokens; an empty table gives no rows. Each row has its result, so rows that repeat an id, or a row, each have theirs. Columns other
than the id and the text are not read, whatever their names. Ids are packed as little-endian unsigned 32-bit
integers, so that a row of any length stays one binary value.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch

#: Characters of a leaf of the tree, which is encoded in one piece.
LEAF = 400
#: Characters of a window at a seam up to which it is encoded in one piece; longer ones go match by match.
FLAT = 1 << 15
#: Bytes of a pattern match from which its tokens are joined from halves.
LONG_MATCH = 1 << 14
_SAFE = regex.compile(r"(?<=[\w!-/:-@\[-`{-~]) ")


class TreeCodec:
    """Encodes and decodes by the ranks of a tokenizer file; no special tokens."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, long_match: int = LONG_MATCH, flat: int = FLAT):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = np.array([len(t) for t in self.bytes_of], np.int64)
        self.pattern, self.leaf, self.long_match, self.flat = regex.compile(pattern), leaf, long_match, flat
        self.joins = 0  # of halves, so far

    def _flat(self, text: str) -> np.ndarray:
        return np.asarray(self.core.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self._flat(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self._join(left, self.encode(left), right, self.encode(right))

    def _join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        self.joins += 1
        width = 64
        while True:
            cut = self._last_cut(left, width)
            until = _SAFE.search(right[:width])
            if cut is not None and until:
                break
            if width >= max(len(left), len(right)):
                break
            width *= 2
        start, end = cut or 0, until.start() if until else len(right)
        head = len(a) - self._tokens_of(a[::-1], len(left[start:].encode())) if start else 0
        tail = self._tokens_of(b, len(right[:end].encode()))
        return np.concatenate([a[:head], self._window(left[start:] + right[:end]), b[tail:]])

    @staticmethod
    def _last_cut(left: str, width: int) -> int | None:
        base = max(0, len(left) - width)
        found = None
        for found in _SAFE.finditer(left, base):  # noqa: B007
            pass
        return found.start() if found else None

    def _tokens_of(self, ids: np.ndarray, size: int) -> int:
        """How many of the first tokens make up so many bytes."""
        return int(np.searchsorted(np.cumsum(self.length[ids[:size]]), size, side="left")) + 1 if size else 0

    def _window(self, text: str) -> np.ndarray:
        if len(text) <= self.flat:
            return self._flat(text)
        return np.concatenate([self._match(m.group()) for m in self.pattern.finditer(text)] or [np.zeros(0, np.uint32)])

    def _match(self, text: str) -> np.ndarray:
        return np.asarray(self._single(text.encode()), np.uint32)

    def _single(self, data: bytes) -> list[int]:
        """Tokens of one match's bytes."""
        if len(data) <= self.long_match:
            return self.core._core_bpe.encode_single_piece(data)
        half = len(data) // 2
        a, b = self._single(data[:half]), self._single(data[half:])
        width = 8
        while True:
            head, tail = max(0, len(a) - width), min(len(b), width)
            middle = self.core._core_bpe.encode_single_piece(b"".join(self.bytes_of[t] for t in (*a[head:], *b[:tail])))
            if (not head or self._fits(a[head - 1], middle[0])) and (tail == len(b) or self._fits(middle[-1], b[tail])):
                return a[:head] + middle + b[tail:]
            width *= 2

    def _fits(self, x: int, y: int) -> bool:
        return self.core._core_bpe.encode_single_piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.core._core_bpe.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> TreeCodec:
    """One codec for each worker process and file."""
    return TreeCodec(path, pattern)


def packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: its id, ids (binary, packed), decoded (binary). Other columns are left out."""
    kind = df.schema[id_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(path, pattern)
        ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([packed(x) for x in ids], pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["id", "ids", "decoded"]
        )

    return by_batch(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), step, f"id {kind}, ids binary, decoded binary")


def decode(df: DataFrame, path: str, pattern: str, id_col: str, ids_col: str) -> DataFrame:
    """The bytes of packed ids; null ids give empty bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(path, pattern)
        out = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    return by_batch(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), step, f"id {kind}, decoded binary")


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and hashes of what encode_decode returns."""
    return encoded.select(
        F.col("id").alias("doc_id"), n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
