"""SentencePiece encoding and decoding: byte-pair merges over flat numpy arrays of symbols.

A text is escaped (a space becomes U+2581, one is put in front) and cut into words, which begin with U+2581;
no piece of a usable model reaches across such a cut, so words are encoded apart from each other.
Words that a bounded cache doesn't hold are merged together in rounds: the best pair of each word is found by a segmented
minimum over pair ranks, all its leftmost occurrences are merged at once, and the arrays are compacted, until no pair remains.
Where a merge makes a pair of the same or a better rank, only the leftmost occurrence is merged, which is what a queue would do.
Nulls and empty texts give the begin and end ids alone.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweave.llm.common import bounded_batches, texts

_NONE = np.iinfo(np.int32).max
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """A byte-pair model with byte fallback and identity normalisation.

    cache_words bounds the distinct words remembered by a process, batch_symbols the symbols merged at once.
    """

    def __init__(self, path: str, cache_words: int = 800_000, batch_symbols: int = 300_000):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("only byte-pair models with identity normalisation are supported")
        sp = SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.size = sp.bos_id(), sp.eos_id(), len(model.pieces)
        self.bytes_at = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_ids = [self.bytes_at[f"<0x{b:02X}>"] for b in range(256)]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(re.search("[^▁]▁", p) for p in normal):
            raise ValueError("a piece reaches across words")
        order = {s: r for r, s in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        self.score_rank = {i: order[model.pieces[i].score] for i in normal.values()}
        # Symbols are piece ids; a character without a piece is `size` and its code point, which no pair contains.
        self.chars = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = normal.get(piece[:cut]), normal.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (self.score_rank[i], i)
        self.pairs = pairs
        self._table(pairs)
        piece_bytes = [p.piece.replace("▁", " ").encode() if p.type in (1, 4) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" for p in model.pieces]
        self.piece_data = np.frombuffer(b"".join(piece_bytes), dtype=np.uint8)
        self.piece_lengths = np.array([len(x) for x in piece_bytes])
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.is_byte = np.array([p.type == 6 for p in model.pieces])
        self.cache_words, self.batch_symbols = cache_words, batch_symbols
        self.cache: dict[str, bytes] = {}

    def _table(self, pairs: dict[int, tuple[int, int]]) -> None:
        """An open-addressing hash table in numpy arrays, a quarter full at most."""
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int64)
        self.rank, self.merged = np.full(1 << bits, _NONE, dtype=np.int32), np.zeros(1 << bits, dtype=np.int32)
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        values = np.array(list(pairs.values()), dtype=np.int32).reshape(-1, 2)
        self.probes, at, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]]] = keys[left[free]]
            won = self.slots[at[left]] == keys[left]
            self.rank[at[left[won]]], self.merged[at[left[won]]] = values[left[won]].T
            left = left[~won]
            at[left] = (at[left] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (lower is merged first, or _NONE) and merged symbol of each pair."""
        keys = a.astype(np.int64) * self.size + b
        keys[(a >= self.size) | (b >= self.size)] = -2
        at = self._slot(keys)
        rank, merged = np.full(len(keys), _NONE, dtype=np.int32), np.zeros(len(keys), dtype=np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.slots[at[todo]]
            hit = found == keys[todo]
            rank[todo[hit]], merged[todo[hit]] = self.rank[at[todo[hit]]], self.merged[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) % len(self.slots)
        return rank, merged

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after all merges, one word after the other, and where each word begins and the last ends."""
        flat = self.chars[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")]
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        rank, merged = np.full(len(flat), _NONE, dtype=np.int32), np.zeros(len(flat), dtype=np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], merged[inner] = self._look(flat[inner], flat[inner + 1])
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        slow = np.zeros(len(words), dtype=np.int32)
        while n := len(flat):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, n]))
            over = best == _NONE
            if over.any():
                parts.append((word[over], flat[over]))
            pos = np.flatnonzero((rank == best) & ~over)
            if not len(pos):
                break
            # Of occurrences that overlap, every second one from the left; their symbols form a chain of neighbours.
            index = np.arange(len(pos))
            pos = pos[(index - np.maximum.accumulate(np.where(np.r_[True, np.diff(pos) != 1], index, 0))) % 2 == 0]
            symbols, gone = flat.copy(), np.zeros(n, dtype=bool)
            symbols[pos], gone[pos + 1] = merged[pos], True
            # New pairs, with the neighbours before and after this round, must be worse than the pair that is merged.
            owner, level = word[pos], rank[pos]
            after, before = pos + 2, pos - 1
            has_after, has_before = after < n, before >= 0
            has_after[has_after] = word[after[has_after]] == owner[has_after]
            has_before[has_before] = word[before[has_before]] == owner[has_before]
            after, before = after[has_after], before[has_before]
            before_now = before - gone[before]
            right, right_to = self._look(symbols[pos[has_after]], symbols[after])
            left, left_to = self._look(symbols[before_now], symbols[pos[has_before]])
            bad = [owner[has_after][right <= level[has_after]], owner[has_before][left <= level[has_before]]]
            if len(mixed := np.flatnonzero(symbols[after] != flat[after])):
                r, _ = self._look(symbols[pos[has_after][mixed]], flat[after[mixed]])
                bad.append(owner[has_after][mixed][r <= level[has_after][mixed]])
            if len(mixed := np.flatnonzero(before_now != before)):
                r, _ = self._look(flat[before[mixed]], symbols[pos[has_before][mixed]])
                bad.append(owner[has_before][mixed][r <= level[has_before][mixed]])
            risky = np.zeros(len(words), dtype=bool)
            risky[np.concatenate(bad)] = True
            rank[pos] = _NONE
            rank[pos[has_after]], merged[pos[has_after]] = right, right_to
            rank[before_now], merged[before_now] = left, left_to
            keep = ~gone & ~over
            if risky.any():
                # In these words only the leftmost occurrence is merged; their ranks are looked up again.
                drop = pos[risky[owner] & np.r_[False, owner[1:] == owner[:-1]]]
                symbols[drop], gone[drop + 1] = flat[drop], False
                slow += risky
                keep = ~gone & ~over
                again = np.flatnonzero(keep & risky[word])
                rank[again] = _NONE
                pair = np.flatnonzero(word[again[:-1]] == word[again[1:]])
                rank[again[pair]], merged[again[pair]] = self._look(symbols[again[pair]], symbols[again[pair + 1]])
                # Ties all along a long word: a queue takes them one by one without going over the arrays.
                for w in np.flatnonzero(slow > 64):
                    inside = keep & (word == w)
                    done = self._queue(symbols[inside])
                    parts.append((np.full(len(done), w, dtype=np.int32), done))
                    keep &= ~inside
                    slow[w] = 0
            flat, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
        owners, symbols = (np.concatenate(x) if parts else np.empty(0, dtype=np.int32) for x in (list(zip(*parts, strict=True)) or ([], [])))
        order = np.argsort(owners, kind="stable")
        return symbols[order], np.searchsorted(owners[order], np.arange(len(words) + 1))

    def _queue(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges by a priority queue: best rank first, then leftmost."""
        s = symbols.tolist()
        n, nxt, prv, heap = len(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1)), []

        def offer(i: int) -> None:
            if i >= 0 and (j := nxt[i]) < n and s[i] < self.size and s[j] < self.size and (p := self.pairs.get(s[i] * self.size + s[j])):
                heapq.heappush(heap, (p[0], i, s[i], s[j], p[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            if s[i] != a or nxt[i] >= n or s[nxt[i]] != b:
                continue
            j = nxt[i]
            s[i], s[j], nxt[i] = m, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(prv[i])
            offer(i)
        return np.array([x for x in s if x >= 0], dtype=np.int32)

    def _remember(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks, U+2581 before each, as little-endian unsigned 32-bit integers."""
        symbols, at = self.merge(["▁" + c.replace(" ", "▁") for c in chunks])
        if len(symbols) and symbols.max() >= self.size:  # characters without a piece become their bytes
            as_bytes = [[s] if s < self.size else [self.byte_ids[b] for b in chr(s - self.size).encode()] for s in symbols.tolist()]
            at = np.r_[0, np.cumsum([len(x) for x in as_bytes])][at]
            symbols = np.array([i for x in as_bytes for i in x])
        raw, ends = symbols.astype("<u4").tobytes(), (at * 4).tolist()
        return {c: raw[i:j] for c, i, j in zip(chunks, ends, ends[1:], strict=False)}

    def encode(self, docs: list[str]) -> list[bytes]:
        """Ids of each text, begin and end ids included, as little-endian unsigned 32-bit integers."""
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (self.bos, self.eos))
        if len(self.cache) > self.cache_words:  # the older half goes
            self.cache = dict(islice(self.cache.items(), len(self.cache) // 2, None))
        # Between single spaces each chunk stands for itself behind U+2581; other texts are one chunk and not remembered.
        simple = [bool(t) and "▁" not in t and "  " not in t and t[0] != " " and t[-1] != " " for t in docs]
        cut = [t.split(" ") if ok else [t] if t else [] for t, ok in zip(docs, simple, strict=True)]
        cache = self.cache
        fresh = list(set().union(*[c for c, ok in zip(cut, simple, strict=True) if ok]).difference(cache))
        odd = list({c[0] for c, ok in zip(cut, simple, strict=True) if c and not ok})
        once = {}
        for chunks, into in ((fresh, cache), (odd, once)):
            batch, room = [], self.batch_symbols
            for i, chunk in enumerate(chunks):
                batch.append(chunk)
                room -= len(chunk)
                if room <= 0 or i == len(chunks) - 1:
                    into |= self._remember(batch)
                    batch, room = [], self.batch_symbols
        return [b"".join([begin, *map((cache if ok else once).__getitem__, words), end]) for words, ok in zip(cut, simple, strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text of ids: U+2581 is a space, the one in front goes, runs of bytes become characters or U+FFFD each."""
        return self.decode_bytes(ids).decode()

    def decode_bytes(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, dtype="<u4")
        found = found[(found != self.bos) & (found != self.eos)]
        if not len(found):
            return b""
        # Scatter: each piece's bytes are copied to where the lengths before it end.
        lengths = self.piece_lengths[found]
        ends = np.cumsum(lengths)
        raw = self.piece_data[np.arange(ends[-1]) + np.repeat(self.piece_starts[found] - ends + lengths, lengths)].tobytes()
        raw = raw[1:] if raw[:1] == b" " and not self.is_byte[found[0]] else raw
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _groups(docs: list[bytes], limit: int = 1 << 20) -> Iterator[list[str]]:
    group, size = [], 0
    for t in docs:
        group.append(t.decode(errors="replace"))
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids themselves where asked for.

    `model` is the path of the model file on every machine. Null and empty texts have the begin and end ids alone and decode to
    an empty text; texts of any length are encoded whole. Rows stay as they are: repeated ids give repeated rows, no rows none.
    Columns other than doc_id and text are ignored, whatever their names.
    """
    fields = f"doc_id long, {SCHEMA}" + ", ids binary" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        gc.disable()  # millions of cached strings and no cycles
        try:
            for batch in batches:
                n, a, b, raw = [], [], [], []
                for group in _groups(texts(batch.column(1))):
                    for ids in c.encode(group):
                        n.append(len(ids) // 4)
                        a.append(hashlib.sha256(ids).hexdigest())
                        b.append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
                        if with_ids:
                            raw.append(ids)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)
        finally:  # the process goes on to tasks of other operators
            c.cache.clear()
            gc.enable()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, fields)
