"""Media columns: content-addressed payloads in tar shards, with rows that carry digest, offset and length.

A payload is stored as a greyscale PNG of 8-bit samples, 64 to a row, as a member `<sha256>.png` of a tar shard in a shared
folder. A shard holds a payload once; of several shards that hold it, all rows refer to the first by name and offset. Metadata
columns come from range reads of the PNG header alone; features from a read of the whole member. A shard's name and bytes
depend on the task's input only and it appears by a rename, so tasks can be repeated.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweave.llm.common import bounded_batches, filesystem, partitions, shared_dir, texts, written

WIDTH = 64
#: Bytes after which a task begins another shard, and the length of a PNG's signature and IHDR chunk.
SHARD, HEADER = 256 << 20, 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The digest is the 32 bytes, as hexadecimal digits would double what is shuffled and written.
CATALOG = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"


def payload(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (WIDTH if not text else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(samples: bytes) -> bytes:
    """A PNG of the samples, which must be a positive multiple of 64."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def decode(media: bytes) -> bytes:
    """The samples of a PNG that `encode` made."""
    width, height, _ = read_header(media[:HEADER])
    at, body = len(_SIGNATURE), []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy in bits of the samples."""
    counts = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    deviation = max(0.0, float(counts @ (np.arange(256) ** 2)) / len(samples) - mean * mean) ** 0.5
    return f"{mean:.4f} {deviation:.4f} {abs(float(-(share * np.log2(share)).sum())):.4f}"


class _Shard:
    def __init__(self, uri: str, name: str):
        self.fs, folder = filesystem(uri)
        self.fs.create_dir(folder)
        self.name, self.path, self.draft = name, f"{folder}/{name}", f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.out, self.size, self.held = self.fs.open_output_stream(self.draft), 0, {}

    def add(self, media: bytes) -> tuple[bytes, int, int]:
        digest = hashlib.sha256(media).digest()
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(media)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % 512))
            self.held[digest] = self.size + 512
            self.size += 512 + len(media) + -len(media) % 512
        return digest, self.held[digest], len(media)

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()
        self.fs.move(self.draft, self.path)


def _store(uri: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, shard = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rows = []
            for t in texts(batch.column(1)):
                if shard is None:
                    shard = _Shard(uri, f"shard-{part:06d}-{n:04d}.tar")
                digest, offset, length = shard.add(encode(payload(t)))
                rows.append((len(t), digest, shard.name, offset, length))
                if shard.size >= SHARD:
                    shard.close()
                    shard, n = None, n + 1
            kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    return run


def _stored(docs: DataFrame, uri: str) -> tuple[DataFrame, DataFrame]:
    """Writes payloads to shards under `uri`: doc_id, n_bytes and digest of all rows, and where each digest is stored first."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(docs.mapInArrow(_store(uri), CATALOG), "catalog")
    # A written table, so that a join may split the rows of a payload that very many documents share.
    first = written(rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*"), "first")
    return rows.select("doc_id", "n_bytes", "digest"), first


def store(docs: DataFrame, uri: str) -> DataFrame:
    """Writes payloads of docs (doc_id, text) to shards under `uri`; the catalog's rows refer to the first copy of each payload."""
    rows, first = _stored(docs, uri)
    return rows.join(first, "digest").select("doc_id", "n_bytes", "digest", "shard", "offset", "length")


def _read(uri: str, whole: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(uri)
        last, file = None, None
        for batch in batches:
            out = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != last:
                    last, file = shard, fs.open_input_file(f"{folder}/{shard}")
                media = bytes(file.read_at(length if whole else HEADER, offset))
                if whole:
                    samples = decode(media)
                    out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
                else:
                    out.append(read_header(media))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] if whole else [pa.int32()] * 3
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] if whole else ["width", "height", "bits"]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["digest", *names])

    return run


def _each(catalog: DataFrame) -> DataFrame:
    """Every payload once, each shard's in order in one task; a catalog without doc_id has it once already."""
    found = catalog.select("digest", "shard", "offset", "length")
    if "doc_id" in catalog.columns:
        found = found.groupBy("digest").agg(F.first(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return found.repartition(partitions(catalog.sparkSession), "shard").sortWithinPartitions("shard", "offset")


def metadata(catalog: DataFrame, uri: str) -> DataFrame:
    """The catalog with width, height and bits, for which only headers are read."""
    found = _each(catalog).mapInArrow(_read(uri, False), "digest binary, width int, height int, bits int")
    return catalog.join(written(found, "headers"), "digest")


def features(catalog: DataFrame, uri: str) -> DataFrame:
    """Digests of payload and media, and a feature, of each payload of the catalog, from the stored bytes."""
    fields = "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _each(catalog).mapInArrow(_read(uri, True), fields)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text of docs (doc_id, text) and reads it back, with digests, a feature and the metadata columns.

    Null is an empty text, whose payload is 64 zero bytes. Repeated rows and ids give repeated rows, and equal texts equal
    values; no rows give no rows and no shards. A payload is held in memory whole, a text of any length being one. Columns
    other than doc_id and text are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    uri = shared_dir(docs.sparkSession) + "/media"
    rows, first = _stored(docs, uri)
    # Once for each payload; only then do the rows join, in one step that can be split where many share a payload. Digests are bytes until then.
    digests = ("payload_sha256", "media_sha256")
    read = features(first, uri).withColumns({c: F.unhex(c) for c in digests})
    known = written(metadata(first, uri).drop("length").join(read, "digest"), "payloads").withColumns({c: F.lower(F.hex(c)) for c in digests})
    return rows.join(known, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height")
