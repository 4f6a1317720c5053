r"""Chat formatting by columnar byte assembly.

A turn becomes `### role: text</turn>` and a line feed. Inside texts and roles a backslash goes
before every backslash, ### and </turn> (in roles also before a colon), so the marks of the
template can't be forged and reading back restores the text. Rows meet by conversation, sorted by
turn, and are streamed: lengths, offsets and scatter indices are computed in numpy for some
megabytes at a time and headers and contents copied into one preallocated buffer. A conversation
that doesn't fit in one such block comes as several chunks, numbered from 0, so none is too long.

Defined results: null roles and texts are empty; rows with null conversation are one conversation;
rows that tie on the turn are ordered by role and text, and repeated rows stay; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of content that are assembled at once.
BLOCK = 4 << 20
#: Bytes that are copied by one array of indices.
SLICE = 256 << 10
FOOT = b"</turn>\n"
_MARK = re.compile(rb"\\(\\|###|</turn>|:)")


def escape(col: pa.Array, role: bool = False) -> pa.Array:
    for mark in ("\\", "###", "</turn>") + (":",) * role:
        col = pc.replace_substring(col, mark, "\\" + mark)
    return col


def unescape(text: bytes) -> bytes:
    return _MARK.sub(rb"\1", text)


def _copy(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """out[to[i]:] = data[start[i] : start[i] + length[i]] for all i: short ones at once by indices, in slices of SLICE bytes, long ones each."""
    for i in np.flatnonzero(length > SLICE):
        out[to[i] : to[i] + length[i]] = data[start[i] : start[i] + length[i]]
    short = np.flatnonzero((length > 0) & (length <= SLICE))
    ends = np.cumsum(length[short])
    lo = 0
    while lo < len(short):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        s = short[lo:hi]
        n = length[s]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to[s], n) + inner] = data[np.repeat(start[s], n) + inner]
        lo = hi


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a large_string array without nulls."""
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] else np.zeros(0, dtype=np.uint8)
    return data, offsets


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, loss_role: str) -> tuple[pa.Array, list[list[tuple[int, int]]], np.ndarray]:
    """Strings of the runs that start at the rows first, the byte spans of each under the loss mask, and turns of each."""
    known = roles.dictionary_encode()
    data, off = _bytes(texts)
    heads = [b"### " + x.encode() + b": " for x in escape(known.dictionary, role=True).to_pylist()]
    table, code = np.frombuffer(b"".join(heads), dtype=np.uint8), np.asarray(known.indices)
    hlen = np.array([len(h) for h in heads], dtype=np.int64)
    hstart, h, n = (np.cumsum(hlen) - hlen)[code], hlen[code], np.diff(off)
    total = h + n + len(FOOT)
    at = np.cumsum(total) - total
    raw = pa.allocate_buffer(int(total.sum()))
    out = np.frombuffer(raw, dtype=np.uint8)
    _copy(out, at, table, hstart, h)
    _copy(out, at + h, data, off[:-1], n)
    foot = np.frombuffer(FOOT, dtype=np.uint8)
    _copy(out, at + h + n, foot, np.zeros(len(n), dtype=np.int64), np.full(len(n), len(foot)))
    bounds = np.append(at[first], int(total.sum()))
    strings = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), raw])
    run = np.searchsorted(first, np.arange(len(n)), "right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in first]
    for i in np.flatnonzero(np.asarray(pc.equal(roles, loss_role)).astype(bool)):
        a = int(at[i] + h[i] - bounds[run[i]])
        spans[run[i]].append((a, a + int(n[i])))
    return strings, spans, np.diff(np.append(first, len(n)))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv, chunk, n_turns, formatted, loss_spans): conversations as strings, with the byte spans to be learnt. Chunks of a conversation lie in order in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk = object(), 0
        for b in batches:
            roles, texts = (pc.fill_null(b.column(i).cast(pa.large_string()), "") for i in (1, 2))
            texts = escape(texts)
            size = np.cumsum(np.diff(_bytes(texts)[1]))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK, "right")))
                convs = b.column(0).slice(lo, hi - lo)
                ids = convs.to_pylist()
                first = np.array([0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]])
                strings, spans, turns = assemble(roles.slice(lo, hi - lo), texts.slice(lo, hi - lo), first, loss_role)
                numbers = np.zeros(len(first), dtype=np.int32)
                numbers[0] = chunk = chunk + 1 if ids[0] == last else 0
                chunk = chunk if len(first) == 1 else 0
                last, lo = ids[-1], hi
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                marked = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind)
                yield pa.RecordBatch.from_arrays([convs.take(pa.array(first)), pa.array(numbers), pa.array(turns), strings.cast(pa.string()), marked], names=["conv", "chunk", "n_turns", "formatted", "loss_spans"])

    base = rows.select(F.col(conv_col).alias("conv"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), F.col(turn_col).alias("turn"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = base.repartition(parts, "conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    kind = dict(base.dtypes)["conv"]
    return ordered.mapInArrow(run, f"conv {kind}, chunk int, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")


def parse(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn, restored."""

    def free(mark: bytes, at: int) -> int:
        """Where mark stands next without a backslash of its own."""
        while True:
            i = formatted.index(mark, at)
            j = i
            while j > 0 and formatted[j - 1] == 92:
                j -= 1
            if (i - j) % 2 == 0:
                return i
            at = i + 1

    at = 0
    while at < len(formatted):
        colon = free(b": ", at + 4)
        end = free(FOOT, colon + 2)
        yield unescape(formatted[at + 4 : colon]), unescape(formatted[colon + 2 : end])
        at = end + len(FOOT)


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What reading the chunks back gives for each conversation: turns, texts under the mask, lengths and their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None

        def row(x: list) -> pa.RecordBatch:
            cols = [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]]
            types = [kind_of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            kind_of, done = b.column(0).type, []
            for conv, _, _, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        done.append(row(open_))
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = text.encode()
                for role, said in parse(raw):
                    open_[1] += 1
                    open_[2].update(role + b"\n" + said + b"\n")
                for s in spans:
                    learnt = unescape(raw[s["start"] : s["end"]])
                    open_[3] += len(learnt.decode())
                    open_[4].update(learnt)
                open_[5] += len(text)
            yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()
        if open_ is not None:
            yield row(open_)

    kind = dict(formatted.dtypes)["conv"]
    return formatted.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv_col)
