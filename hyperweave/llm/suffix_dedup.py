"""Removal of byte strings that an earlier document has, by bounded interval expansion on a Burrows-Wheeler transform.

Every window of LENGTH bytes is keyed by its least 20-byte gram under a hash, so equal windows have equal keys wherever they
stand, and neighbouring windows with the same key form a run. Four steps pass compact arrays, never texts:

1. Texts are written once, as chunks in the shared folder; each chunk offers its distinct keys.
2. Keys that only one document has can't matter. Each chunk is told which of its keys are shared.
3. Chunks give their distinct runs with shared keys, each with the smallest document that has it. Under each key the distinct
   runs are joined, suffix-sorted and transformed; intervals are extended backwards breadth-first, which finds the common
   prefixes of neighbouring suffixes by increasing value and stops at LENGTH. Neighbours that are left share a window, and the
   smallest document of such a class owns it.
4. Each chunk removes the windows that a smaller document owns and reports on its documents.

A chunk adds a key or a run at most once, so a passage that very many documents share costs no more than one that all chunks have.
Where it begins and ends its surroundings differ by document, so a key with very many runs is hot: its runs go as single windows
under 128-bit hashes, which are dealt out by hash, so no task gets all that stands around a common gram.
Nulls are empty texts, texts under LENGTH bytes keep all, and rows that repeat a doc_id count as one document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweave.llm.common import _BASE, _INVERSE, filesystem, mix, partitions, powers, shared_dir, texts, written
from hyperweave.sources.scratch import input_bytes

GRAM = 20
#: Bytes of text in a chunk (one document at least), and in what is hashed at once (a text at most is cut into such segments).
CHUNK, SEGMENT = 4 << 20, 1 << 18
#: Bytes of distinct runs that are transformed at once, a key at least.
BATCH = 1 << 18
#: Runs from which a key is hot. Counts are rounded down to powers of four, so a key that isn't has under four times as many.
HOT = 1 << 14
#: Windows that are hashed at once.
BLOCK = 1 << 15
#: Bytes of input for each bucket.
SHARE = 8 << 20
_FLAGS = np.uint64(15)
_POSITION = np.uint64((1 << 24) - 1)
_LAST = np.iinfo(np.int64).max


def _pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True), dtype=kind)


def _grams(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[GRAM:] - sums[:-GRAM]) * powers(_INVERSE, len(data) - GRAM + 1))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs(docs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with the same key in each text: index of the text, first window, number of windows, key."""
    out = []
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        data = np.frombuffer(b"".join(x for _, _, x in group), dtype=np.uint8)
        sizes = np.array([len(x) for _, _, x in group])
        first = np.cumsum(sizes) - sizes
        hashes = _grams(data)
        packed = hashes & ~_POSITION | np.arange(len(hashes), dtype=np.uint64)
        at = (_least(packed, length - GRAM + 1) & _POSITION).astype(np.int64)
        piece = np.repeat(np.arange(len(group)), sizes)[: len(at)]
        start = np.arange(len(at))
        valid = start + length <= (first + sizes)[piece]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]) | (valid[1:] != valid[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.r_[begin, len(at)])
        good = valid[begin]
        begin, count = begin[good], count[good]
        index, offset = (np.array([x[k] for x in group])[piece[begin]] for k in (0, 1))
        out.append((index, begin - first[piece[begin]] + offset, count, hashes[at[begin]]))

    for i, text in enumerate(docs):
        for offset in range(0, max(0, len(text) - length + 1), SEGMENT):
            segment = text[offset : offset + SEGMENT + length - 1]
            group.append((i, offset, segment))
            size += len(segment)
            if size >= SEGMENT:
                flush()
                group, size = [], 0
    if group:
        flush()
    if not out:
        return tuple(np.empty(0, dtype=k) for k in (np.int64, np.int64, np.int64, np.uint64))  # type: ignore[return-value]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least (symbols under 512), by doubling."""
    n, bits, width = len(symbols), 9, 7
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(width, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for i in range(width):
        key = key << bits | padded[i : i + n]
    while True:
        order = np.argsort(key)
        found = key[order]
        new = np.zeros(n, dtype=np.int64)
        new[1:] = found[1:] != found[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) + 1
        if width >= depth:
            return order
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (n + 1) + after
        width *= 2


def interval_classes(bwt: np.ndarray, depth: int) -> np.ndarray:
    """For suffixes in sorted order, the number of the class of those that share their first `depth` symbols.

    Level by level: the intervals of all strings of l symbols are extended by the symbol in front; an extension whose end
    hasn't been seen ends where neighbours share exactly l symbols, and is extended in turn.
    """
    n = len(bwt)
    back = np.argsort(bwt, kind="stable")  # where the suffix one longer comes from
    ahead = np.empty(n, dtype=np.int64)
    ahead[back] = np.arange(n)
    front = bwt[back]
    known = np.zeros(n + 1, dtype=bool)
    known[[0, n]] = True
    left, right = np.array([0]), np.array([n])
    for _ in range(depth):
        if not len(left):
            break
        sizes = right - left
        total = int(sizes.sum())
        if total > n // 8:  # all positions, in the order of the extended suffixes
            interval = np.zeros(n + 1, dtype=np.int64)
            interval[left] += np.arange(1, len(left) + 1)
            inside = np.zeros(n + 1, dtype=np.int8)
            inside[left] += 1
            inside[right] -= 1
            interval = np.maximum.accumulate(np.where(interval[:n] > 0, np.arange(n), 0))
            interval[np.cumsum(inside[:n]) == 0] = -1
            own = interval[back]
            edge = np.ones(n, dtype=bool)
            edge[1:] = (own[1:] != own[:-1]) | (front[1:] != front[:-1])
            begin = np.flatnonzero(edge)
            end = np.r_[begin[1:], n]
            good = own[begin] >= 0
            begin, end = begin[good], end[good]
        else:
            which = np.repeat(np.arange(len(left)), sizes)
            at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left, sizes)
            to = ahead[at]
            order = np.lexsort((to, which)) if len(left) < total else np.arange(total)
            to, which = to[order], which[order]
            symbol = front[to]
            edge = np.ones(total, dtype=bool)
            edge[1:] = (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])
            first = np.flatnonzero(edge)
            begin, end = to[first], to[np.r_[first[1:], total] - 1] + 1
        new = ~known[end]
        known[end[new]] = True
        order = np.argsort(begin[new])
        left, right = begin[new][order], end[new][order]
    return np.cumsum(known[:n]) - 1


def window_classes(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of the strings that stand one after the other in `data`: number of the string and class of the window."""
    ends = np.cumsum(sizes)
    symbols = np.zeros(len(data) + len(sizes), dtype=np.uint16)
    place = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
    symbols[place] = data.astype(np.uint16) + 1
    order = suffix_order(symbols, length)
    classes = np.empty(len(symbols), dtype=np.int64)
    classes[order] = interval_classes(symbols[order - 1], length)
    counts = sizes - length + 1
    string = np.repeat(np.arange(len(sizes)), counts)
    window = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends - sizes + np.arange(len(sizes)), counts)
    return string, classes[window]


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """128-bit hashes of the windows that begin at `starts`, two words each."""
    out = np.empty((len(starts), 2), dtype=np.uint64)
    for i in range(0, len(starts), BLOCK):
        at = starts[i : i + BLOCK]
        padded = np.zeros((len(at), -(-length // 8) * 8), dtype=np.uint8)
        padded[:, :length] = data[at[:, None] + np.arange(length)]
        words = padded.view(np.uint64)
        for k, seed in enumerate((_BASE, _INVERSE)):
            found = np.full(len(at), seed, dtype=np.uint64)
            for j in range(words.shape[1]):
                found = mix((found ^ words[:, j]) * np.uint64(seed))
            out[i : i + BLOCK, k] = found
    return out


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Keys are least hashes, so small ones are many; a second hash, without the flags, deals them out evenly."""
    return ((mix(keys >> np.uint64(4)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _store(uri: str, name: str, table: pa.Table) -> None:
    """Writes a file whose name and content depend on the input alone, so that a repeated task changes nothing."""
    fs, path = filesystem(uri)
    fs.create_dir(path)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    pq.write_table(table, draft, filesystem=fs, compression="zstd", compression_level=1, use_dictionary=False, write_statistics=False)
    fs.move(draft, f"{path}/{name}")


def _fetch(uri: str, name: str) -> pa.Table:
    fs, path = filesystem(uri)
    return pq.read_table(f"{path}/{name}", filesystem=fs)


def _rows(table: pa.Table) -> tuple[list, list[bytes]]:
    return table.column("doc_id").to_pylist(), texts(table.column("text").combine_chunks())


def _offer(uri: str, buckets: int, length: int):
    """Step 1: (chunk, bucket, keys); a key's last bit says that several documents of the chunk have it, three more how many runs."""

    def chunk(name: str, rows: pa.Table) -> pa.RecordBatch:
        _store(uri, name, rows)
        ids, docs = _rows(rows)
        index, _, _, key = runs(docs, length)
        owner = np.array([_LAST if i is None else i for i in ids], dtype=np.int64)[index]
        key &= ~_FLAGS
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(first)
        several = owner[at] != owner[np.r_[at[1:], len(key)] - 1] if len(at) else np.empty(0, dtype=bool)
        many = np.searchsorted(4 ** np.arange(1, 8), np.diff(np.r_[at, len(key)]), side="right").astype(np.uint64)
        key = key[at] | many << np.uint64(1) | several
        bucket = _bucket(key, buckets)
        order = np.argsort(bucket, kind="stable")
        key = key[order]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(name, -1, b"")] + [(name, b, key[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], ["chunk", "bucket", "keys"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            begin = 0
            for end, bytes_ in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), 1):
                size += bytes_
                if size >= CHUNK:
                    yield chunk(f"{part}-{n}", pa.Table.from_batches([*held, batch.slice(begin, end - begin)]))
                    n, held, size, begin = n + 1, [], 0, end
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield chunk(f"{part}-{n}", pa.Table.from_batches(held))

    return run


def _shared(hot_from: int):
    """Step 2, for the keys of a bucket: for each chunk those that several documents have; the last bit says that a key is hot."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("chunk").to_pylist()
        keys = [np.frombuffer(k, dtype=np.uint64) for k in table.column("keys").to_pylist()]
        flat, source = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        plain = flat >> np.uint64(4)
        order = np.argsort(plain, kind="stable")
        plain = plain[order]
        edge = np.flatnonzero(np.r_[True, plain[1:] != plain[:-1]])
        number = np.add.reduceat(np.int64(1) << (flat[order] & _FLAGS & ~np.uint64(1)).astype(np.int64), edge)
        hot = np.repeat((number >= hot_from).astype(np.uint64), np.diff(np.r_[edge, len(plain)]))
        several = (flat[order] & np.uint64(1)).astype(bool)
        same = plain[1:] == plain[:-1]
        several[1:] |= same
        several[:-1] |= same
        keep = order[several]
        source, flat = source[keep], flat[keep] & ~_FLAGS | hot[several]
        order = np.argsort(source, kind="stable")
        source, flat = source[order], flat[order]
        cuts = np.searchsorted(source, np.arange(len(keys) + 1))
        rows = [(names[k], flat[i:j].tobytes()) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.string()), "keys": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _give(uri: str, buckets: int, length: int):
    """Step 3, first half: (chunk, bucket, owners, sizes, bytes) of the chunk's distinct runs with shared keys.

    Buckets from `buckets` on have the hashes of the distinct windows with hot keys instead, without sizes.
    """

    def run(table: pa.Table) -> pa.Table:
        name = table.column("chunk")[0].as_py()
        shared = np.unique(np.concatenate([np.frombuffer(k, dtype=np.uint64) for k in table.column("keys").to_pylist()]))
        stored = _fetch(uri, name)
        ids, docs = _rows(stored)
        index, start, count, key = runs(docs, length)
        plain = key & ~_FLAGS
        near = shared[np.minimum(np.searchsorted(shared & ~_FLAGS, plain), len(shared) - 1)]
        hit, hot = near & ~_FLAGS == plain, (near & np.uint64(1)).astype(bool)
        whose = np.array([_LAST if i is None else i for i in ids], dtype=np.int64)
        rows = []

        def give(where: np.ndarray, owner: np.ndarray, pack: Callable[[np.ndarray], tuple[bytes, bytes]]) -> np.ndarray:
            """Adds a row for each bucket; the new numbers of the strings, in the order of their buckets."""
            order = np.argsort(where, kind="stable")
            edge = np.flatnonzero(np.r_[True, where[order][1:] != where[order][:-1]]) if len(order) else order
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=False):
                rows.append((name, int(where[order[i]]), _pack(owner[order[i:j]]), *pack(order[i:j])))
            new = np.empty(len(order), dtype=np.int64)
            new[order] = np.arange(len(order))
            return new

        mine = hit & ~hot
        runs_of = [x[mine] for x in (index, start, count)]
        bucket = _bucket(key[mine], buckets)
        numbers: dict[bytes, int] = {}
        number = np.array([numbers.setdefault(docs[d][s : s + c + length - 1], len(numbers)) for d, s, c in zip(*(x.tolist() for x in runs_of), strict=True)], dtype=np.int64)
        where, owner = np.zeros(len(numbers), dtype=np.int64), np.full(len(numbers), _LAST)
        where[number] = bucket
        np.minimum.at(owner, number, whose[runs_of[0]])
        every = list(numbers)

        def strings(order: np.ndarray) -> tuple[bytes, bytes]:
            found = [every[k] for k in order]
            return np.array([len(x) for x in found], dtype=np.uint16).tobytes(), _pack(np.frombuffer(b"".join(found), dtype=np.uint8))

        string = give(where, owner, strings)[number]
        mine = hit & hot
        if mine.any():
            c = count[mine]
            doc, first = np.repeat(index[mine], c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[mine], c)
            begins = np.cumsum([0, *map(len, docs)])
            hashes = window_hashes(np.frombuffer(b"".join(docs), dtype=np.uint8), begins[doc] + first, length)
            order = np.lexsort((hashes[:, 1], hashes[:, 0]))
            new = np.r_[True, (hashes[order[1:]] != hashes[order[:-1]]).any(axis=1)]
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.cumsum(new) - 1
            hashes = hashes[order[new]]
            owner = np.minimum.reduceat(whose[doc[order]], np.flatnonzero(new))
            single = give(_bucket(hashes[:, 0], buckets) + buckets, owner, lambda order: (b"", hashes[order].tobytes()))
            runs_of = [np.r_[x, y] for x, y in zip(runs_of, (doc, first, np.ones(len(doc), dtype=np.int64)), strict=True)]
            string = np.r_[string, single[number] + len(numbers)]
        _store(uri, f"{name}.runs", pa.table({"doc": runs_of[0].astype(np.int32), "start": runs_of[1], "count": runs_of[2].astype(np.int32), "string": string.astype(np.int32)}))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["chunk", "bucket", "owners", "sizes", "bytes"])

    return run


def _stretches(name: str, bucket: int, whose: np.ndarray) -> tuple[str, int, bytes, bytes]:
    edge = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
    return name, bucket, _pack(np.diff(np.r_[edge, len(whose)])), _pack(whose[edge])


def _own(buckets: int, length: int):
    """Step 3, second half, for a bucket: owners of the windows of each chunk's runs, as lengths and values of equal stretches."""

    def windows(table: pa.Table, owners: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Each chunk's owners of windows with hot keys."""
        hashes = np.frombuffer(b"".join(table.column("bytes").to_pylist()), dtype=np.uint64).reshape(-1, 2)
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        new = np.r_[True, (hashes[order[1:]] != hashes[order[:-1]]).any(axis=1)]
        whose = np.empty(len(order), dtype=np.int64)
        whose[order] = np.minimum.reduceat(np.concatenate(owners)[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        ends = np.cumsum([len(x) for x in owners])
        return (whose[j - len(x) : j] for x, j in zip(owners, ends, strict=True))

    def answer(rows: list[tuple[str, int, bytes, bytes]]) -> pa.Table:
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "bucket", "lengths", "values"])

    def run(table: pa.Table) -> pa.Table:
        names, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        owners = [_unpack(x, np.int64) for x in table.column("owners").to_pylist()]
        if bucket >= buckets:
            return answer([_stretches(name, bucket, whose) for name, whose in zip(names, windows(table, owners), strict=True)])
        sizes = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in table.column("sizes").to_pylist()]).astype(np.int64)
        data = b"".join([_unpack(x, np.uint8).tobytes() for x in table.column("bytes").to_pylist()])
        ends = np.cumsum(sizes).tolist()
        numbers: dict[bytes, int] = {}
        number = np.array([numbers.setdefault(data[j - s : j], len(numbers)) for s, j in zip(sizes.tolist(), ends, strict=True)], dtype=np.int64)
        smallest = np.full(len(numbers), _LAST)
        np.minimum.at(smallest, number, np.concatenate(owners))
        own_sizes = np.array([len(x) for x in numbers], dtype=np.int64)
        flat = np.frombuffer(b"".join(numbers), dtype=np.uint8)
        counts = own_sizes - length + 1
        first, begin = np.cumsum(counts) - counts, np.cumsum(own_sizes) - own_sizes
        owner = np.empty(int(counts.sum()), dtype=np.int64)
        # Equal windows have equal keys, so keys are taken in batches that bound the transform's memory.
        key = (_grams(flat) >> np.uint64(24))[begin[:, None] + np.arange(length - GRAM + 1)].min(axis=1)
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        size = np.add.reduceat(own_sizes[order], edge)
        batch = (np.cumsum(size) - size) // BATCH
        for i, j in zip(cuts := edge[np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]])].tolist(), [*cuts[1:], len(order)], strict=True):
            mine = order[i:j]
            n = own_sizes[mine]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[mine], n)
            string, cls = window_classes(flat[at], n, length)
            best = np.full(int(cls.max()) + 1, _LAST)
            np.minimum.at(best, cls, smallest[mine][string])
            c = counts[mine]
            owner[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[mine], c)] = best[cls]
        out, at = [], 0
        for name, mine in zip(names, owners, strict=True):
            k = number[at : at + len(mine)]
            at += len(mine)
            c = counts[k]
            whose = owner[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[k], c)]
            out.append(_stretches(name, bucket, whose))
        return answer(out)

    return run


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes the windows that begin at `starts` cover."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:n]) > 0


def _remove(uri: str, length: int, finish: Callable[[pa.Table, list, list], pa.Table]):
    """Step 4, for a chunk: masks of removed bytes, handed to `finish` with the rows and texts."""

    def run(table: pa.Table) -> pa.Table:
        name = table.column("chunk")[0].as_py()
        stored = _fetch(uri, name)
        ids, docs = _rows(stored)
        masks: list[np.ndarray | None] = [None] * len(docs)
        answers = sorted((b, x, y) for b, x, y in zip(*(table.column(c).to_pylist() for c in ("bucket", "lengths", "values")), strict=True) if b >= 0)
        if answers:
            owner = np.concatenate([np.repeat(_unpack(y, np.int64), _unpack(x, np.int64)) for _, x, y in answers])
            found = _fetch(uri, f"{name}.runs")
            doc, start, count, string = (found.column(c).to_numpy().astype(np.int64) for c in ("doc", "start", "count", "string"))
            counts = np.zeros(int(string.max()) + 1, dtype=np.int64)
            counts[string] = count
            first = np.cumsum(counts) - counts
            order = np.argsort(doc, kind="stable")
            doc, start, count, string = doc[order], start[order], count[order], string[order]
            cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
            for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                d, c = int(doc[i]), count[i:j]
                k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                gone = owner[k + np.repeat(first[string[i:j]], c)] < (_LAST if ids[d] is None else ids[d])
                if gone.any():
                    masks[d] = covered(len(docs[d]), (k + np.repeat(start[i:j], c))[gone], length)
        return finish(stored, docs, masks)

    return run


def _buckets(docs: DataFrame) -> int:
    """A number that grows with partitions and with the input, so that what meets in one bucket doesn't grow with the input."""
    return max(4 * partitions(docs.sparkSession), input_bytes(docs) // SHARE)


def _steps(docs: DataFrame, length: int, finish, schema) -> DataFrame:
    """docs: rows with doc_id and text, and whatever `finish` needs besides."""
    spark = docs.sparkSession
    uri, n = shared_dir(spark) + "/chunks", _buckets(docs)
    offered = written(docs.mapInArrow(_offer(uri, n, length), "chunk string, bucket int, keys binary"), "keys")
    shared = offered.where("bucket >= 0").groupBy("bucket").applyInArrow(_shared(HOT), "chunk string, keys binary")
    # Not written as a table: it is read once, and a lost part is made again from the stored chunks and keys.
    given = shared.groupBy("chunk").applyInArrow(_give(uri, n, length), "chunk string, bucket int, owners binary, sizes binary, bytes binary")
    owned = given.groupBy("bucket").applyInArrow(_own(n, length), "chunk string, bucket int, lengths binary, values binary")
    chunks = offered.where("bucket < 0").select("chunk", "bucket", F.lit(None).cast("binary").alias("lengths"), F.lit(None).cast("binary").alias("values"))
    return owned.union(chunks).groupBy("chunk").applyInArrow(_remove(uri, length, finish), schema)


def _digests(rows: pa.Table, docs: list[bytes], masks: list) -> pa.Table:
    size, gone, spans, kept = [], [], [], []
    for text, mask in zip(docs, masks, strict=True):
        size.append(len(text))
        gone.append(0 if mask is None else int(mask.sum()))
        spans.append(0 if mask is None else int(np.count_nonzero(np.diff(np.r_[False, mask].astype(np.int8)) == 1)))
        kept.append(hashlib.sha256(text if mask is None else np.frombuffer(text, dtype=np.uint8)[~mask].tobytes()).hexdigest())
    return pa.table([rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept_text(rows: pa.Table, docs: list[bytes], masks: list) -> pa.Table:
    """Characters that are removed in part stay whole, so that the text stays valid."""
    out: list[str | None] = rows.column("text").to_pylist()
    for k, (text, mask) in enumerate(zip(docs, masks, strict=True)):
        if mask is not None:
            data = np.frombuffer(text, dtype=np.uint8)
            char = np.cumsum((data & 0xC0) != 0x80) - 1
            out[k] = data[(np.bincount(char, weights=~mask) > 0)[char]].tobytes().decode(errors="replace")
    return rows.set_column(rows.column_names.index("text"), "text", pa.array(out, pa.string()))


def removed_digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed stretches) and kept_sha256 of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _steps(rows, length, _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of docs, in all their columns, with what is left of their texts."""
    return _steps(docs, length, _kept_text, docs.schema)
