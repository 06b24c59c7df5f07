"""The corpus pipeline: toxicity, near-duplicates, repeated passages, source mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and returns rows in the columns of documents, the last the encoded texts; each stage's
rows are written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm.common import documents, written
from hyperweave.llm.minhash_dedup import near_duplicates
from hyperweave.llm.queries import tokenizer_path
from hyperweave.llm.sentencepiece_codec import encode_documents
from hyperweave.llm.source_mixing import mixed
from hyperweave.llm.suffix_dedup import without_repeats
from hyperweave.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 of their five-word shingles the one with the smallest id stays.

    Rows with a null id are held against none and stay.
    """
    named = docs.where("doc_id is not null")
    kept = near_duplicates(named, words=5, percent=80).where("kept").select("doc_id")
    return named.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes on that a document with a smaller id has go; n_chars follows the text."""
    return without_repeats(docs, length=50).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, little-endian unsigned 32-bit integers, with their number and digests."""
    return encode_documents(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", substring_dedup),
    ("source_mixing", mixing),
    ("sentencepiece", tokenize),
]

#: Learned models and hashes of texts decide, which SQL can't follow; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
