"""Chat formatting by columnar byte assembly.

Rows are dealt by conversation and sorted by turn.  For every Arrow batch the
lengths of all segments (headers, escaped contents, footers) give cumulative
offsets, and one scatter copies each segment column into one preallocated
buffer that becomes the output column.  A conversation that runs over a batch
border comes out in several parts, so no conversation has to fit in a task.

Template: ``[INST] role\\n text [/INST]`` for a turn of any other role and
``<s>role\\n text</s>`` for an assistant's.  Control strings inside texts get one
backslash more after their first character (``</s>`` -> ``<\\/s>``, ``<\\/s>`` ->
``<\\\\/s>``), which takes one backslash off to undo.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = (r"([<\[])(\\*)(/?s>|/?INST\])", r"\1\\\2\3")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_TURN = re.compile(r"\[INST\] ([^\n]*)\n(.*?) \[/INST\]|<s>([^\n]*)\n(.*?)</s>", re.S)
FORMATTED = "conv_id long, part int, formatted string, loss array<struct<start:int,end:int>>"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, *CONTROL)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text) if "\\" in text else text


def _role_out(role: str) -> str:
    """A role as one line, reversibly."""
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C").replace("[", "%5B")


def _role_in(role: str) -> str:
    return role.replace("%5B", "[").replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def _column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 offsets of a large_string column without nulls."""
    offs = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offs


def assemble(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate string columns row by row into one buffer.

    Returns the buffer and the (rows x columns + 1) offsets of every segment.
    """
    parts = [_column(c) for c in columns]
    lens = np.stack([o[1:] - o[:-1] for _, o in parts], axis=1)
    starts = np.zeros(lens.size + 1, np.int64)
    np.cumsum(lens.ravel(), out=starts[1:])
    out = np.empty(starts[-1], np.uint8)
    for k, (raw, offs) in enumerate(parts):
        n, to = lens[:, k], starts[k:-1:len(parts)]
        src = raw[offs[0]:offs[-1]]
        if len(src):
            out[np.arange(len(src)) + np.repeat(to - (offs[:-1] - offs[0]), n)] = src
    return out, starts


def _format_batches(batches):
    conv, part = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_pylist()
        roles = pc.fill_null(b.column(1), "").cast(pa.large_string())
        texts = escape(pc.fill_null(b.column(2), "").cast(pa.large_string()))
        said = roles.dictionary_encode()
        names = said.dictionary.to_pylist()
        take = lambda xs: pa.array(xs, pa.large_string()).take(said.indices)
        head = take([f"<s>{_role_out(r)}\n" if r == "assistant" else f"[INST] {_role_out(r)}\n" for r in names])
        foot = take(["</s>" if r == "assistant" else " [/INST]" for r in names])
        out, starts = assemble([head, texts, foot])
        first = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
        is_loss = np.array([r == "assistant" for r in names], bool)[said.indices.to_numpy()]
        spans, parts = [], []
        for a, z in zip(first, [*first[1:], len(ids)]):
            part = part + 1 if (a == 0 and conv is not None and ids[a] == conv[0]) else 0
            conv = (ids[a],)
            parts.append(part)
            base = starts[3 * a]
            spans.append([{"start": int(starts[3 * i + 1] - base), "end": int(starts[3 * i + 2] - base)}
                          for i in np.flatnonzero(is_loss[a:z]) + a])
        offs = starts[[3 * i for i in [*first, len(ids)]]]
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(out))
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[a] for a in first], pa.int64()), pa.array(parts, pa.int32()), text.cast(pa.string()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            names=["conv_id", "part", "formatted", "loss"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, loss) of ``turns`` (conv_id, turn, role, text).

    ``loss`` lists the byte spans of assistant texts within the part.  Rows are
    ordered by turn, then role and text (nulls first), so ties are settled;
    repeated rows are repeated turns.  A null text or role is an empty one, a
    null conv_id is a conversation of its own, a null turn comes first.  Parts
    of a conversation are consecutive in one partition, in order.
    """
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format_batches, FORMATTED)


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        self.chars += len(formatted)
        raw, at = formatted.encode(), 0
        for m in _TURN.finditer(formatted):
            if m.start() != at:
                raise ValueError("formatted text has bytes between turns")
            at = m.end()
            role, text = (m[1], m[2]) if m[1] is not None else (m[3], m[4])
            self.turns.update(f"{_role_in(role)}\n{unescape(text)}\n".encode())
            self.n += 1
        if at != len(formatted):
            raise ValueError("formatted text ends inside a turn")
        for s in loss:
            text = unescape(raw[s["start"]:s["end"]].decode())
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def row(self, conv):
        return (conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _read_batches(batches):
    names = [x.strip().split()[0] for x in READ_BACK.split(",")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    conv, digest, rows = None, None, []
    for b in batches:
        for c, part, text, loss in zip(*(b.column(i).to_pylist() for i in range(4))):
            if part == 0:
                if digest is not None:
                    rows.append(digest.row(conv))
                conv, digest = c, _Digest()
            digest.add(text, loss)
        if len(rows) >= 4096:
            yield out(rows)
            rows = []
    if digest is not None:
        rows.append(digest.row(conv))
    if rows:
        yield out(rows)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from the formatted text and its loss spans, part by part."""
    return formatted.mapInArrow(_read_batches, READ_BACK)
