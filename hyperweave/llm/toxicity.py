"""Toxicity by two class-conditional Kneser-Ney models over the spelling of words, toxic and ordinary.

A word is a run of letters (bytes from 0x80 on count as letters) with A-Z lower-cased; its symbols are a mark for its begin,
its bytes and a mark for its end. In class c, for a symbol s after the h before it in the word, ORDER - 1 at most,

    P_c(s | h) = max(n_c(h s) - D, 0) / n_c(h) + D types_c(h) / n_c(h) P_c(s | h without its first symbol)

and P_c(s | h) = P_c(s | h without its first symbol) where the class has no h. n_c are numbers of texts for the longest strings
and, as Kneser and Ney have it, numbers of distinct symbols before the string for shorter ones. Strings of SHARED symbols and
less are what both classes share: their probabilities come from the words of all documents, labelled or not. So an expression
that is rare in a class is smoothed by its parts: words with the begin of a known insult are known, too.

A word's two log-likelihoods give a ratio, and a document's feature is the logarithm of the mean of its square root over the
document's distinct words. So length is normalised away and a line that is repeated a hundred times counts once. (The mean of
the logarithms themselves lets hundreds of ordinary words, each with a little chance in it, outvote two insults; the mean of a
square root of a ratio isn't above 1 for words of the ordinary model, however badly rare ones are estimated.) A rising curve fitted on labelled rows of another fold turns it into the chance of being labelled toxic. The log ratios are tables in
the shared folder that tasks map into memory.

The models are fitted on at most ROWS_PER_CLASS labelled rows of each class, and at most ORDINARY_PER_TOXIC ordinary ones for a
toxic one; the curve on CURVE_ROWS of each, weighed as the classes are among all labelled rows. Nothing else is cut off: all
words of these rows, and of all documents for the shared counts, take part; only labels are held out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm.common import bounded_batches, filesystem, groups, in_fold, range_hashes, shared_dir, texts, written

#: Labelled rows of each class that the models are fitted on, and of each class that the curve is.
ROWS_PER_CLASS, CURVE_ROWS, ORDINARY_PER_TOXIC = 6000, 2000, 4
#: Longest strings of symbols, seven at most as a 64-bit key holds them and their length; longest ones that the classes share.
ORDER, SHARED = 7, 2
DISCOUNT = 0.75
#: Words that say nothing, added to each text: a mean over a handful of words is mostly chance.
PRIOR_WORDS = 20
#: Distinct words whose ratios a process remembers.
REMEMBERED = 1 << 19
_BEGIN, _END = 1, 2
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


@dataclass
class Words:
    """The distinct words of some texts: their bytes one after the other, bounds, hashes, and (text, word) pairs, each once."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    word: np.ndarray


def words(docs: list[bytes]) -> Words:
    data = _LOWER[np.frombuffer(b" ".join([*docs, b""]), dtype=np.uint8)]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _LETTER[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in docs])]
    hashes, first, word = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
    text = np.searchsorted(begins, starts, side="right") - 1
    pair = np.unique(text * max(1, len(hashes)) + word)
    return Words(data, starts[first], ends[first], hashes, pair // max(1, len(hashes)), pair % max(1, len(hashes)))


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol of each word, marks of begins apart: the last ORDER symbols up to it as a number, how many, and the word."""
    size = ends - starts + 2
    last = np.cumsum(size)
    first = last - size
    out = np.zeros(last[-1] if len(last) else 0, dtype=np.uint8)
    out[first], out[last - 1] = _BEGIN, _END
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(out)) - first[word]
    inner = (place > 0) & (place < size[word] - 1)
    out[inner] = data[(starts[word] + place - 1)[inner]]
    value = np.zeros(len(out), dtype=np.uint64)
    for j in range(ORDER):
        value[j:] |= out[: len(out) - j].astype(np.uint64) << _U(8 * j)
    have = np.minimum(place + 1, ORDER)
    at = place > 0
    return cut(value, have)[at], have[at], word[at]


def cut(value: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The key of the last `size` symbols of a number or key: these in the low bytes, their number in the highest."""
    size = np.asarray(size).astype(np.uint64)
    return value & ((_U(1) << (size * _U(8))) - _U(1)) | size << _U(56)


def before(key: np.ndarray) -> np.ndarray:
    """The keys without their last symbols."""
    return cut((key & _U((1 << 56) - 1)) >> _U(8), (key >> _U(56)) - _U(1))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of the rows of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts[order], first, axis=0) if len(keys) else counts


def _levels(keys: np.ndarray, counts: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the strings and their counts: of the longest as given, of others the distinct symbols before them in each class."""
    size, out = keys >> _U(56), {}
    longer, n = np.empty(0, dtype=np.uint64), np.empty((0, counts.shape[1]))
    for k in range(order, 0, -1):
        own = size == k
        out[k] = longer, n = _summed(np.r_[keys[own], cut(longer, k)], np.r_[counts[own], (n > 0).astype(float)])
    return out


def _found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys stand among sorted known ones, and whether they do."""
    if not len(known):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def estimate(keys: np.ndarray, counts: np.ndarray, order: int, least: int, floor) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Probabilities in each class of the strings from `least` symbols on, by length, and the contexts with the weights of what is shorter.

    keys, counts: the longest strings and a column for each class. floor: gives probabilities of strings one symbol shorter.
    """
    probability, contexts, weights = {}, [], []
    for k, (level, n) in sorted(_levels(keys, counts, order).items()):
        if k < least:
            continue
        context, at = np.unique(before(level), return_inverse=True)
        total, given = np.zeros((len(context), n.shape[1])), np.zeros((len(context), n.shape[1]))
        np.add.at(total, at, n)
        np.add.at(given, at, np.minimum(n, DISCOUNT))
        weight = np.where(total > 0, given / np.maximum(total, 1), 1.0)
        if k == least:
            low = floor(cut(level, k - 1))
        else:
            low = probability[k - 1][1][_found(probability[k - 1][0], cut(level, k - 1))[0]]
        probability[k] = level, np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[at] + weight[at] * low
        contexts.append(context), weights.append(weight)
    every = np.concatenate(contexts) if contexts else np.empty(0, dtype=np.uint64)
    order_ = np.argsort(every)
    return probability, (every[order_], (np.concatenate(weights) if weights else np.empty((0, counts.shape[1])))[order_])


def _spread(found: Words, weight: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest strings, up to `order` symbols, of words with their weights (a row for each)."""
    value, have, word = spelled(found.data, found.starts, found.ends)
    return _summed(cut(value, np.minimum(have, order)), weight[word])


def _corpus(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the number of texts that have them, a group of texts at a time."""
    for batch in batches:
        for group in groups(texts(batch.column(0)), 1 << 20):
            w = words(group)
            raw = w.data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[i:j] for i, j in zip(w.starts.tolist(), w.ends.tolist(), strict=True)], pa.binary()), pa.array(np.bincount(w.word, minlength=len(w.hashes)))], ["w", "n"])


def _shared_strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of SHARED symbols of words with their numbers of texts."""
    for batch in batches:
        raw = batch.column(0).to_pylist()
        ends = np.cumsum([len(x) for x in raw])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        found = Words(data, np.r_[0, ends[:-1]] if len(raw) else ends, ends, ends, ends, ends)
        keys, n = _spread(found, batch.column(1).to_numpy().astype(float)[:, None], SHARED)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n[:, 0])], ["key", "n"])


def _class_strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of ORDER symbols of (text, toxic) with the number of times that texts of each class have them in distinct words."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for c in (0, 1):
            for group in groups(texts(batch.column(0).filter(pa.array(toxic == c))), 1 << 20):
                w = words(group)
                keys, n = _spread(w, np.bincount(w.word, minlength=len(w.hashes)).astype(float)[:, None], ORDER)
                zero = np.zeros(len(n))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(zero if c else n[:, 0]), pa.array(n[:, 0] if c else zero)], ["key", "n0", "n1"])


@lru_cache(maxsize=32)
def _mapped(uri: str, kind: str) -> np.ndarray:
    """The numbers of a file, mapped into memory; a file elsewhere is copied to a nameless one first."""
    fs, path = filesystem(uri)
    if not fs.get_file_info(path).size:
        return np.empty(0, dtype=kind)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with TemporaryFile() as out, fs.open_input_stream(path) as file:
        while part := file.read(1 << 22):
            out.write(part)
        out.flush()
        return np.memmap(out, dtype=kind, mode="r")


@dataclass(frozen=True)
class Table:
    """Numbers by sorted 64-bit keys, a file for either in the shared folder."""

    uri: str

    @staticmethod
    def of(spark: SparkSession, keys: np.ndarray, values: np.ndarray) -> Table:
        uri = shared_dir(spark)
        fs, folder = filesystem(uri)
        fs.create_dir(folder)
        for name, x in (("keys", keys.astype("<u8")), ("values", values.astype("<f4"))):
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(x.tobytes())
        return Table(uri)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys there are, and their numbers, 0 for the others."""
        known, values = _mapped(f"{self.uri}/keys", "<u8"), _mapped(f"{self.uri}/values", "<f4")
        at, hit = _found(known, keys)
        return hit, np.where(hit, values[at] if len(values) else 0.0, 0.0)


#: Hashes of words in order, and their square roots of ratios, by model.
_remembered: dict[str, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Model:
    """Log ratios of strings, of what contexts leave to shorter ones, and the curve; no tables where a class is missing."""

    string: Table | None = None
    context: Table | None = None
    at: tuple[float, ...] = (0.0,)
    chance: tuple[float, ...] = (0.0,)

    def ratios(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word."""
        value, have, word = spelled(data, starts, ends)
        out = np.zeros(len(value))
        todo = np.arange(len(value))
        for k in range(ORDER, SHARED, -1):
            longest = todo[have[todo] >= k]
            keys = cut(value[longest], k)
            hit, ratio = self.string.find(keys)
            out[longest] += np.where(hit, ratio, self.context.find(before(keys))[1])
            done = np.zeros(len(value), dtype=bool)
            done[longest[hit]] = True
            todo = todo[~done[todo]]
        return np.bincount(word, weights=out, minlength=len(starts))

    def features(self, docs: list[bytes]) -> np.ndarray:
        """Logarithm of the mean square root of the likelihood ratio of each text's distinct words and PRIOR_WORDS more of ratio 1."""
        w = words(docs)
        if not len(w.hashes) or self.string is None or self.context is None:
            return np.zeros(len(docs))
        known, root = _remembered.get(self.string.uri, (np.empty(0, dtype=np.uint64), np.empty(0)))
        at, hit = _found(known, w.hashes)
        mine = np.where(hit, root[at] if len(root) else 0.0, 0.0)
        fresh = np.flatnonzero(~hit)
        mine[fresh] = np.exp(np.minimum(0.5 * self.ratios(w.data, w.starts[fresh], w.ends[fresh]), 300.0))
        if len(known) > REMEMBERED:
            known, root = known[:0], root[:0]
        keys = np.r_[known, w.hashes[fresh]]
        order = np.argsort(keys, kind="stable")
        _remembered.clear()
        _remembered[self.string.uri] = keys[order], np.r_[root, mine[fresh]][order]
        return np.log1p(np.bincount(w.text, weights=mine[w.word] - 1, minlength=len(docs)) / (np.bincount(w.text, minlength=len(docs)) + PRIOR_WORDS))

    def scores(self, docs: list[bytes]) -> np.ndarray:
        return np.interp(self.features(docs), self.at, self.chance)


def _arrays(df: DataFrame, columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a table whose size the sample of labelled rows, or the number of short strings, bounds."""
    found = df.select("key", *columns).toArrow()
    return found.column("key").to_numpy().view(np.uint64), np.stack([found.column(c).to_numpy() for c in columns], axis=1).astype(float)


def _estimate(labelled: DataFrame, corpus: DataFrame) -> Model:
    """Both models from (text, toxic) and the words (w, n) of all documents."""
    spark = labelled.sparkSession
    strings = labelled.mapInArrow(_class_strings, "key long, n0 double, n1 double").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    keys, counts = _arrays(written(strings, "strings"), ("n0", "n1"))
    if not len(keys) or not counts.any(axis=0).all():
        return Model()
    short, n = _arrays(written(corpus.mapInArrow(_shared_strings, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")), "shared"), ("n",))
    common, _ = estimate(short, n, SHARED, 1, lambda k: np.full((len(k), 1), 1 / 256))
    least = float(min((p.min() for _, p in common.values()), default=1 / 256))

    def floor(k: np.ndarray) -> np.ndarray:
        at, hit = _found(common[SHARED][0], k)
        return np.where(hit, common[SHARED][1][at, 0] if len(common[SHARED][0]) else least, least)[:, None]

    probability, (context, weight) = estimate(keys, counts, ORDER, SHARED + 1, floor)
    # Keys begin with their lengths, so the levels one after the other are in order.
    string = np.concatenate([level for level, _ in probability.values()])
    ratio = np.concatenate([np.log(p[:, 1] / p[:, 0]) for _, p in probability.values()])
    return Model(Table.of(spark, string, ratio), Table.of(spark, context, np.log(weight[:, 1] / weight[:, 0])))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The rising curve of the chance of class 1 that fits best, by pooling neighbours that fall.

    A pool is level from its least to its largest x; from one to the next the curve is linear, so it crosses 1/2 midway between
    classes that don't overlap.
    """
    pools: list[list[float]] = []  # weight, weighted y, least and largest x
    order = np.lexsort((y, x))
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        pools.append([w, w * b, a, a])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0] or pools[-2][3] == pools[-1][2]):
            w_, b_, _, end = pools.pop()
            pools[-1] = [pools[-1][0] + w_, pools[-1][1] + b_, pools[-1][2], end]
    # A little certainty is kept back, so that the curve rises everywhere.
    at = [x.min() - 1, *(e for p in pools for e in p[2:]), x.max() + 1]
    chance = np.repeat([p[1] / p[0] for p in pools], 2)
    rise = np.linspace(0.0005, 0.9995, len(at))
    return tuple(map(float, at)), tuple(map(float, 0.998 * np.r_[chance[0], chance, chance[-1]] + 0.002 * rise))


def _pick(labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` labelled ids of each class, and ORDINARY_PER_TOXIC ordinary ones for each toxic one, by a hash of the id."""
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    toxic = labels.where("toxic = 1").orderBy(order, "doc_id").limit(rows)
    ordinary = min(rows, ORDINARY_PER_TOXIC * toxic.count())
    return labels.where("toxic = 0").orderBy(order, "doc_id").limit(ordinary).union(toxic)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from texts of docs (doc_id, text) and labels (doc_id, toxic) of rows outside fold 0; fold 1 is for the curve."""
    docs = docs.select("doc_id", "text")
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = written(usable, "labels")
    bounded_batches(docs.sparkSession)
    corpus = written(docs.select("text").mapInArrow(_corpus, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    chosen = written(_pick(usable.where(~in_fold(F.col("doc_id"), 1)), ROWS_PER_CLASS).withColumn("curve", F.lit(False)).union(_pick(usable.where(in_fold(F.col("doc_id"), 1)), CURVE_ROWS).withColumn("curve", F.lit(True))), "chosen")
    sample = written(docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "toxic", "curve").dropDuplicates(["text", "toxic", "curve"]), "sample")
    model = _estimate(sample.where("not curve").select("text", "toxic"), corpus)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(g) for g in groups(texts(batch.column(0)), 1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0)), batch.column(1)], ["x", "toxic"])

    known = sample.where("curve").select("text", "toxic").mapInArrow(features, "x double, toxic int").toPandas()
    y = known["toxic"].to_numpy(dtype=float)
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if 0 < y.sum() < len(y):
        model.at, model.chance = _curve(known["x"].to_numpy(), y, np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y))
    else:
        model.chance = (share,)
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    held_out: crc32 of the id as text is 0 modulo 5; labels of such rows aren't learned from. Null and empty texts have the
    feature 0, as have all without labels of both classes. Repeated texts of a class count once in the fit; an id with several
    labels is toxic if one says so; null labels and labels of null ids don't count. Repeated rows and ids give repeated rows, no
    rows none. Texts are scored whole; equal features have equal scores. Other columns are ignored, whatever their names.
    """
    model = train(docs, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(g) for g in groups(texts(batch.column(2)), 1 << 20)]
            score = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), in_fold(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, bound: float = 0.5) -> DataFrame:
    """The rows of docs, in all their columns, whose score is under `bound`."""
    model = train(docs, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(g) for g in groups(texts(batch.column("text")), 1 << 20)]
            yield batch.filter(pa.array((np.concatenate(parts) if parts else np.empty(0)) < bound))

    return docs.mapInArrow(run, docs.schema)
