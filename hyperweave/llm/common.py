"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits texts into words; only these six ASCII characters separate.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_U = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C55, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where none is named and all is one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hyperweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Lets Arrow batches between JVM and Python end at so many rows or bytes, since texts differ in length a thousandfold."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def split_words(text) -> F.Column:
    """The words of a text column as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def word_count(text) -> F.Column:
    """Number of words without building them: word starts are characters after a separator."""
    marked = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.filter(F.split(marked, " ", -1), lambda w: w != "")).cast("long")


def in_fold(doc_id, fold: int = 0, folds: int = 5) -> F.Column:
    """Whether crc32 of the id as text falls in `fold`; null ids are in fold 0's complement."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % folds) == fold, F.lit(False))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; nulls are empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base & _MASK, dtype=np.uint64)
        steps[0] = 1
        got = _powers[base] = np.multiply.accumulate(steps)
        if n > 1 << 22:  # a very long text: don't keep its table
            del _powers[base]
    return got[:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], equal for equal bytes wherever they stand."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shingle_sets(docs: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, A-Z lower-cased, and where each text's begin and the last's end.

    A text with fewer words than `size` has its whole sequence as one shingle, one without words none.
    """
    data = _LOWER[np.frombuffer(b"\n".join([*docs, b""]), dtype=np.uint8)]
    begins = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in docs], out=begins[1:])
    starts, ends = word_bounds(data)
    words = range_hashes(data, starts, ends)
    at = np.searchsorted(starts, begins).tolist()
    windows = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for i in range(size):
        windows = mix(windows + words[i : i + len(windows)])
    parts = []
    for i, j in zip(at, at[1:], strict=False):
        if j - i >= size:
            part = windows[i : j - size + 1].copy()
            part.sort()
        else:
            part = np.zeros(int(j > i), dtype=np.uint64)
            for w in words[i:j]:
                part = mix(part + w)
        parts.append(part)
    flat = np.concatenate(parts) if parts else windows[:0]
    bounds = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in parts], out=bounds[1:])
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[bounds[:-1][bounds[:-1] < len(flat)]] = True
    return flat[new], np.r_[0, np.cumsum(new)][bounds]


def shingles(text: bytes, size: int) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text], size)[0]


def groups(docs: list[bytes], limit: int = 1 << 18) -> Iterator[list[bytes]]:
    """Consecutive texts of about `limit` bytes together, one at least."""
    group, size = [], 0
    for t in docs:
        group.append(t)
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group
