"""The semantic plane: a hashing text encoder and exact nearest vectors by cosine distance."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1 << 16)
def _features(token: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signed weights of a word and of the trigrams of the marked word, by their MD5 digests."""
    marked, places, weights = f"^{token}$", [], []
    for feature, w in [(token, 1.0), *((marked[i : i + 3], 0.5) for i in range(len(marked) - 2))]:
        digest = hashlib.md5(feature.encode(), usedforsecurity=False).hexdigest()
        places.append(int(digest[:15], 16) % dims)
        weights.append(w if digest[15] >= "8" else -w)
    return np.array(places), np.array(weights)


def encode_texts(texts: list[str | None], dims: int = 256) -> np.ndarray:
    """Unit vectors of signed feature hashes, a row for each text: words weigh 1, trigrams a half; zero for no word or null."""
    found = [[_features(token, dims) for token in _TOKEN.findall((t or "").lower())] for t in texts]
    at = [row * dims + places for row, features in enumerate(found) for places, _ in features]
    weights = [w for features in found for _, w in features]
    if not at:
        return np.zeros((len(texts), dims), dtype=np.float32)
    out = np.bincount(np.concatenate(at), weights=np.concatenate(weights), minlength=len(texts) * dims).reshape(-1, dims)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def encode_text(text: str | None, dims: int = 256) -> np.ndarray:
    """The vector of one text."""
    return encode_texts([text], dims)[0]


def embed(docs: DataFrame, dims: int = 256) -> DataFrame:
    """atom_id and vector of every row of docs (atom_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encode_texts(batch.column(1).to_pylist(), dims)
            ends = pa.array(np.arange(len(vectors) + 1) * dims, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel(), pa.float32()))], ["atom_id", "vector"])

    return docs.select(F.col("atom_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "atom_id long, vector array<float>")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; 1 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(1 - dot(a, b) / F.when(norms != 0, norms))


def nearest(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """atom_id and distance of the k nearest of vectors (atom_id, vector), exact, equal distances by id."""
    if not 1 <= k <= 1000:
        raise ValueError("k is from 1 to 1000")
    target = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("atom_id", cosine_distance(F.col("vector"), target).alias("distance")).orderBy("distance", "atom_id").limit(k)
