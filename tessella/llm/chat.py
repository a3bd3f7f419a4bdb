"""Chat formatting by token-level assembly.

Each turn's text is encoded apart from the template; the template's control strings are reserved
ids that no text can encode to. The loss mask covers the texts of assistant turns; its token
ranges come from prefix sums of segment lengths.

A turn is rendered as ``<s>`` marker text ``</s>``, where the marker is ``[SYS]``, ``[INST]`` or
``[/INST]`` for system, user and assistant, and ``[ROLE]`` role ``[/ROLE]`` for any other role.
Control strings inside texts and roles get a backslash after their first character (``<s>`` becomes
``<\\s>``, ``<\\s>`` becomes ``<\\\\s>``), which unescape() takes back, so that any text survives.

Null texts and roles count as empty. Turns are ordered by turn (null first), then role, then text,
so repeated turns have a defined place and each count. Null conversation ids make up one conversation. An empty table gives no rows. Columns other
than those named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, packed
from .common import by_batch

CONTROL = ("<s>", "</s>", "[SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
MARKERS = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
#: The tails of control strings after their first characters; used by escape() and by the SQL of the query.
TAILS = r"(/?s>|SYS\]|/?INST\]|/?ROLE\])"
_PLAIN = regex.compile(r"([<\[])(\\*)" + TAILS)
_ESCAPED = regex.compile(r"([<\[])\\(\\*)" + TAILS)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Template:
    """Segments of one turn as ids; reserved ids follow the tokenizer's own."""

    def __init__(self, path: str, pattern: str):
        self.bpe = codec(path, pattern)
        self.first = len(self.bpe.bytes_of)
        self.id_of = {c: self.first + i for i, c in enumerate(CONTROL)}

    def turn(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """Ids, and the half-open token range of the loss within them (empty but for assistants)."""
        head = [self.id_of["<s>"]]
        if role in MARKERS:
            segments = [head + [self.id_of[MARKERS[role]]]]
        else:
            segments = [head + [self.id_of["[ROLE]"]], self.bpe.encode(escape(role)), [self.id_of["[/ROLE]"]]]
        body = self.bpe.encode(escape(text))
        sizes = np.cumsum([len(s) for s in segments] + [len(body)])
        ids = np.concatenate([*(np.asarray(s, np.uint32) for s in segments), body, np.asarray([self.id_of["</s>"]], np.uint32)])
        return (ids, int(sizes[-2]), int(sizes[-1])) if role == "assistant" else (ids, 0, 0)

    def text(self, ids: np.ndarray) -> str:
        """Ids as text, control strings included."""
        out, at = [], 0
        for i in np.flatnonzero(ids >= self.first):
            out += [self.bpe.decode(ids[at:i]), CONTROL[int(ids[i]) - self.first].encode()]
            at = i + 1
        return b"".join([*out, self.bpe.decode(ids[at:])]).decode()

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of one turn's ids."""
        special = np.flatnonzero(ids >= self.first)
        kinds = [CONTROL[int(ids[i]) - self.first] for i in special]
        plain = lambda a, b: unescape(self.bpe.decode(ids[a:b]).decode())
        if kinds[1] == "[ROLE]":
            return plain(special[1] + 1, special[2]), plain(special[2] + 1, special[3])
        return next(r for r, m in MARKERS.items() if m == kinds[1]), plain(special[1] + 1, special[2])


_templates: dict[tuple[str, str], Template] = {}


def template(path: str, pattern: str) -> Template:
    if (path, pattern) not in _templates:
        _templates[path, pattern] = Template(path, pattern)
    return _templates[path, pattern]


def format_turns(df: DataFrame, path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each row: conv_id, turn, ids (binary, packed), loss_from and loss_to (tokens within ids). Needs no shuffle."""
    conv, turn = (df.schema[c].dataType.simpleString() for c in (conv_col, turn_col))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = template(path, pattern)
        rows = [t.turn(r or "", x or "") for r, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([packed(r[0]) for r in rows], pa.binary()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))],
            ["conv_id", "turn", "ids", "loss_from", "loss_to"],
        )

    picked = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return by_batch(picked, step, f"conv_id {conv}, turn {turn}, ids binary, loss_from bigint, loss_to bigint")


def read_back(df: DataFrame, path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formats whole conversations and reads them back from the ids: one row for each conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens.
    Turns are encoded before the shuffle; what follows it streams over the sorted turns with the
    state of one conversation's hashes, so that memory does not grow with a conversation.
    """
    conv = df.schema[conv_col].dataType.simpleString()
    keyed = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    turn_kind = df.schema[turn_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = template(path, pattern)
        rows = [t.turn(r, x) for r, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([packed(r[0]) for r in rows], pa.binary()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))],
            ["conv_id", "turn", "role", "text", "ids", "loss_from", "loss_to"],
        )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path, pattern)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
        kind = None
        now, state, done = None, None, []

        def flush(full: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done
            if done and (full or len(done) >= 1000):
                columns = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in columns[1:])], names)
                done = []

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], state[6]))

        for batch in batches:
            kind = batch.column(0).type
            for key, packed_ids, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or key != now:
                    close()
                    yield from flush(False)
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids = np.frombuffer(packed_ids, "<u4")
                role, text = t.read(ids)
                loss = unescape(t.bpe.decode(ids[a:b]).decode())
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(t.text(ids))
                state[5] += len(ids)
                state[6] += b - a
        close()
        yield from flush(True)

    formatted = by_batch(keyed, step, f"conv_id {conv}, turn {turn_kind}, role string, text string, ids binary, loss_from bigint, loss_to bigint")
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "loss_from", "loss_to")
    return ordered.mapInArrow(
        digest, f"conv_id {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"
    )
