"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>role NEWLINE text<|im_end|> NEWLINE`. Inside roles and texts a backslash, `<` and `[` become
backslash b, l and s (in roles a line end backslash n as well), so no control string can occur there and reading back is
exact. For a batch of turns numpy computes lengths, cumulative offsets and scatter indices, and copies headers, escaped
contents and ends into one buffer, which becomes the Arrow column as it is. The loss mask is the spans of assistant texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweave.llm.common import partitions

START, END = b"<|im_start|>", b"<|im_end|>\n"
#: The escaped bytes and their codes.
TEXT_CODES = {0x5C: ord("b"), 0x3C: ord("l"), 0x5B: ord("s")}
ROLE_CODES = TEXT_CODES | {0x0A: ord("n")}


def _codes(codes: dict[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    for k, v in codes.items():
        table[k] = v
    return table


_TEXT, _ROLE = _codes(TEXT_CODES), _codes(ROLE_CODES)


def unescape(raw: bytes) -> bytes:
    """Undoes either escaping; no code can begin inside another, so the order only matters for the backslash."""
    if b"\\" not in raw:
        return raw
    return raw.replace(b"\\l", b"<").replace(b"\\s", b"[").replace(b"\\n", b"\n").replace(b"\\b", b"\\")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, dtype=np.uint8)
    return raw, at - at[0]


def _escaped(data: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the bytes (0: none), escapes before each byte in all, and escaped lengths of the rows."""
    code = codes[data]
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(code != 0, out=before[1:])
    return code, before, np.diff(at) + before[at[1:]] - before[at[:-1]]


def _scatter(out: np.ndarray, begin: np.ndarray, data: np.ndarray, at: np.ndarray, code: np.ndarray, before: np.ndarray) -> None:
    """Copies the rows of `data`, escaped, to where each begins in `out`."""
    if not len(data):
        return
    to = np.repeat(begin - at[:-1] - before[at[:-1]], np.diff(at)) + np.arange(len(data)) + before[:-1]
    hit = code != 0
    out[to] = np.where(hit, 0x5C, data)
    out[to[hit] + 1] = code[hit]


def assemble(roles: pa.Array, contents: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all formatted turns, where each begins (and the last ends), and the span of each content."""
    role, role_at = _flat(roles)
    text, text_at = _flat(contents)
    role_code, role_before, role_size = _escaped(role, role_at, _ROLE)
    text_code, text_before, text_size = _escaped(text, text_at, _TEXT)
    size = len(START) + role_size + 1 + text_size + len(END)
    bounds = np.r_[0, np.cumsum(size)]
    out = np.empty(bounds[-1], dtype=np.uint8)
    begin = bounds[:-1]
    first = begin + len(START) + role_size + 1
    last = first + text_size
    out[begin[:, None] + np.arange(len(START))] = np.frombuffer(START, dtype=np.uint8)
    out[first - 1] = 0x0A
    out[last[:, None] + np.arange(len(END))] = np.frombuffer(END, dtype=np.uint8)
    _scatter(out, begin + len(START), role, role_at, role_code, role_before)
    _scatter(out, first, text, text_at, text_code, text_before)
    return out, bounds, first, last


def _conversations(rows: pa.Table) -> pa.RecordBatch:
    """One row per run of equal conv_id."""
    rows = rows.combine_chunks()
    ids = rows.column("conv_id").combine_chunks()
    key, null = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])])
    turns = np.diff(np.r_[first, len(key)])
    out, bounds, begin, end = assemble(rows.column("role").combine_chunks(), rows.column("text").combine_chunks())
    at = np.r_[bounds[:-1][first], bounds[-1]]
    formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(out)])
    trained = np.flatnonzero(pc.fill_null(pc.equal(rows.column("role"), "assistant"), False).to_numpy())
    owner = np.searchsorted(first, trained, side="right") - 1
    spans = np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x[trained] - at[owner])) for x in (begin, end)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(turns.astype(np.int64)), formatted.cast(pa.binary()), *lists], ["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"])


def _format(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, rows]) if held is not None else rows
        # The last conversation may go on in the next batch.
        ids = held.column("conv_id")
        same = pc.is_null(ids) if not ids[-1].is_valid else pc.fill_null(pc.equal(ids, ids[-1]), False)
        cut = int(np.argmax(same.to_numpy()))
        if cut:
            yield _conversations(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield _conversations(held)


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted (UTF-8) and the loss mask's byte spans, for rows (conv_id, turn, role, text).

    Rows are ordered by turn, null first; equal turns by role and text, and repeated rows all stay. Null roles and texts are
    empty. Rows without a conv_id form one conversation. Other columns are ignored.
    """
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, "conv_id long, n_turns long, formatted binary, loss_starts array<long>, loss_ends array<long>")


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part[len(START) :].partition(b"\n")
        out.append((unescape(role), unescape(text)))
    return out


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for raw, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends")), strict=True):
            turns = read_turns(raw)
            loss = b"".join([unescape(raw[i:j]) for i, j in zip(starts, ends, strict=True)])
            said = hashlib.sha256(b"".join([x for role, text in turns for x in (role, b"\n", text, b"\n")])).hexdigest()
            rows.append((len(turns), said, len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(raw.decode())))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["conv_id", *names])


def chat_digests(rows: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations of `rows`: turns, and the text under the loss mask."""
    return format_chats(rows).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
