"""Language of documents by a bidirectional gated recurrent network over bytes, trained here in numpy.

Texts are cut into windows of WINDOW bytes, the last of a text padded with zero bytes. Two recurrent layers read each window
forwards and backwards; a softmax over both states labels every byte, and a document's probabilities are the mean over all
its bytes. Training is back-propagation through time with Adam on windows of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweave.llm.common import bounded_batches, groups, in_fold, texts

WINDOW, HIDDEN = 64, 8
#: Training reads at most so many rows of each language, in expectation, by a hash of the id, and of these the whole texts.
ROWS_PER_LANGUAGE = 600
STEPS, BATCH, RATE = 240, 512, 0.02
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


class Network:
    """Weights: inputs (2, 3H, 256), recurrent (2, 3H, H), bias of the candidate's recurrent part (2, H, 1), output (2, L, H), (L, 1).

    Rows of a gate block are update, reset, candidate. Gates use tanh(x / 2), which is a sigmoid after scaling.
    """

    def __init__(self, labels: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        put = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {"inputs": put(2, 3 * hidden, 256, scale=0.3), "recurrent": put(2, 3 * hidden, hidden, scale=hidden**-0.5), "bias": np.zeros((2, hidden, 1), dtype=np.float32), "output": put(2, labels, hidden, scale=0.3), "offset": np.zeros((labels, 1), dtype=np.float32)}
        self.hidden = hidden

    def states(self, data: np.ndarray, inside: np.ndarray, keep: bool = False):
        """Hidden states (2, T, H, B) of windows (T, B), the backward ones at the byte they belong to; with `keep` what a backward pass needs.

        Bytes that aren't `inside`, the padding at the end of a text, leave the backward state at zero.
        """
        w, h = self.weights, self.hidden
        steps, n = data.shape
        out = np.empty((2, steps, h, n), dtype=np.float32)
        state, pre = np.zeros((2, h, n), dtype=np.float32), np.empty((2, 3 * h, n), dtype=np.float32)
        trail = []
        half = w["recurrent"] * np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)[:, None]
        table = w["inputs"] * np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)[:, None]
        for t in range(steps):
            np.take(table[0], data[t], axis=1, out=pre[0], mode="clip")
            np.take(table[1], data[steps - 1 - t], axis=1, out=pre[1], mode="clip")
            rec = np.matmul(half, state)
            gates = pre[:, : 2 * h] + rec[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            update, reset = gates[:, :h], gates[:, h:]
            inner = rec[:, 2 * h :] + w["bias"]
            new = inner * reset
            new += pre[:, 2 * h :]
            np.tanh(new, out=new)
            before = state
            state = before - new
            state *= update
            state += new
            state[1] *= inside[steps - 1 - t]
            out[0, t], out[1, steps - 1 - t] = state
            if keep:
                trail.append((before, update, reset, inner, new))
        return (out, trail) if keep else out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, L, B) label probabilities of every byte."""
        logits = np.matmul(self.weights["output"][0], states[0])
        logits += np.matmul(self.weights["output"][1], states[1])
        logits += self.weights["offset"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, inside: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the bytes that are `inside` (T, B), for a label per window."""
        w, h = self.weights, self.hidden
        out, trail = self.states(data, inside, keep=True)
        d = self.probabilities(out)
        d[:, label, np.arange(len(label))] -= 1
        d *= inside[:, None, :] / max(1, inside.sum())
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["offset"] = d.sum(axis=(0, 2))[:, None]
        for k in (0, 1):
            grad["output"][k] = np.einsum("tlb,thb->lh", d, out[k], optimize=True)
        above = np.stack([np.matmul(w["output"][k].T, d) for k in (0, 1)])
        steps, n = data.shape
        carry = np.zeros((2, h, n), dtype=np.float32)
        back = np.transpose(w["recurrent"], (0, 2, 1))
        for t in range(steps - 1, -1, -1):
            before, update, reset, inner, new = trail[t]
            g = carry.copy()
            g[0] += above[0, t]
            g[1] += above[1, steps - 1 - t]
            g[1] *= inside[steps - 1 - t]
            g_new = g * (1 - update) * (1 - new * new)
            g_update = g * (before - new) * update * (1 - update)
            g_reset = g_new * inner * reset * (1 - reset)
            g_inner = g_new * reset
            g_in = np.concatenate([g_update, g_reset, g_new], axis=1)
            g_rec = np.concatenate([g_update, g_reset, g_inner], axis=1)
            grad["recurrent"] += np.matmul(g_rec, np.transpose(before, (0, 2, 1)))
            grad["bias"] += g_inner.sum(axis=2, keepdims=True)
            for k, row in ((0, data[t]), (1, data[steps - 1 - t])):
                order = np.argsort(row, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0])
                grad["inputs"][k][:, row[order[first]]] += np.add.reduceat(g_in[k][:, order], first, axis=1)
            carry = g * update + np.matmul(back, g_rec)
        return grad

    def fit(self, data: np.ndarray, inside: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> None:
        """Adam on random batches with every label equally likely."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        by_label = [np.flatnonzero(label == x) for x in np.unique(label)]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(x, max(1, batch // len(by_label))) for x in by_label])
            grad = self.gradients(data[:, pick], inside[:, pick], label[pick])
            now = rate * (1 - step / (steps + 1))
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.weights[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def windows(docs: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) bytes of the windows of all texts, and each window's text."""
    padded = [t + bytes(-len(t) % size) for t in docs]
    counts = [len(t) // size for t in padded]
    data = np.frombuffer(b"".join(padded), dtype=np.uint8).reshape(-1, size)
    return np.ascontiguousarray(data.T), np.repeat(np.arange(len(docs)), counts)


def _inside(docs: list[bytes], owner: np.ndarray) -> np.ndarray:
    """(T, B): 1 for the bytes of the windows of all texts, 0 for padding."""
    lengths, first = np.array([len(t) for t in docs], dtype=np.int64), np.searchsorted(owner, np.arange(len(docs)))
    left = lengths[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW
    return (np.arange(WINDOW)[:, None] < left).astype(np.float32)


def _sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) of a bounded share of the rows that may be learned from; the rate of a language is its bound over its count."""
    rows = docs.where(F.col("lang").isNotNull() & ~in_fold(F.col("doc_id")) & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    rates = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, ROWS_PER_LANGUAGE / n)))])
    chance = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return sorted((r["lang"], r["text"]) for r in rows.where(chance < rates[F.col("lang")]).select("lang", "text").collect())


def train(docs: DataFrame) -> tuple[list[str], Network] | None:
    """The languages and a network, learned from text and lang of documents outside fold 0; None without such rows.

    Every window of the sampled texts can be drawn, each language as often as any other. Repeated rows count as often as they
    occur; the sample is sorted, so the order of rows changes nothing.
    """
    sample = _sample(docs)
    languages = sorted({k for k, _ in sample})
    cut, owner = windows(found := [t.encode() for _, t in sample])
    if not len(owner):
        return None
    net = Network(len(languages))
    net.fit(cut, _inside(found, owner), np.array([languages.index(k) for k, _ in sample])[owner])
    return languages, net


def pooled(net: Network, docs: list[bytes]) -> np.ndarray:
    """Mean label probabilities over all bytes of each text; zeros for an empty one."""
    labels = len(net.weights["offset"])
    data, owner = windows(docs)
    lengths = np.array([len(t) for t in docs])
    total = np.zeros((len(docs), labels))
    every = _inside(docs, owner)
    for i in range(0, data.shape[1], 2048):
        part, inside = np.ascontiguousarray(data[:, i : i + 2048]), np.ascontiguousarray(every[:, i : i + 2048])
        p = net.probabilities(net.states(part, inside))
        p *= inside[:, None, :]
        np.add.at(total, owner[i : i + 2048], p.sum(axis=0).T)
    return total / np.maximum(lengths, 1)[:, None]


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang).

    held_out: crc32 of the id as text is 0 modulo 5; such rows aren't learned from. lang_pred is a learned language, or `und`
    with score 0 where the text is null, has no letter, or nothing could be learned. score is the mean probability over all
    bytes of the text, however long. Of languages with equal probability the first by code point is taken; repeated rows and
    ids give repeated rows; no rows give no rows. Other columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    model = train(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = [], []
            for group in groups(texts(batch.column(2)), 1 << 17):
                p = pooled(model[1], group) if model else np.zeros((len(group), 1))
                for t, row in zip(group, p, strict=True):
                    known = model is not None and _LETTER.search(t.decode(errors="replace")) is not None
                    best = int(row.argmax())
                    found.append(model[0][best] if known else UNKNOWN)  # type: ignore[index]
                    scores.append(min(1.0, float(row[best])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), in_fold(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
