"""Continuous views: a change log read as a stream, and views kept up to date batch by batch.

Each batch writes a new version of the view and then names it in a small pointer file that a rename puts in place, with the
batch's number, so a repeated batch changes nothing and readers never see a half-written version.
"""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.operators import views

CHANGES = "gen long, at long, edge_id long, member_id long, delta long"


def changes(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Changes as they are appended to a folder of Parquet files."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files).parquet(folder)


def _pointer(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def current(spark: SparkSession, folder: str) -> tuple[DataFrame | None, int]:
    """The view's newest version, and the last batch in it."""
    fs, path = _pointer(folder)
    if fs.get_file_info(f"{path}/current.json").type == pafs.FileType.NotFound:
        return None, -1
    with fs.open_input_stream(f"{path}/current.json") as f:
        at = json.loads(f.read())
    return spark.read.parquet(f"{folder}/version={at['batch']}"), at["batch"]


def _publish(df: DataFrame, folder: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/version={batch}")
    fs, path = _pointer(folder)
    with fs.open_output_stream(f"{path}/next.json") as f:
        f.write(json.dumps({"batch": batch}).encode())
    fs.move(f"{path}/next.json", f"{path}/current.json")


def keep(stream: DataFrame, view: str, folder: str, checkpoint: str, bucket: int = 60_000):
    """Starts a query that keeps a `degree`, `cardinality` or `activity` view in a folder; it takes what there is and stops."""

    def update(batch: DataFrame, number: int) -> None:
        old, last = current(batch.sparkSession, folder)
        if number <= last:
            return
        if view == "activity":
            new = views.activity(batch, bucket)
            if old is not None:
                new = old.union(new).groupBy("bucket").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
        else:
            key, name = {"degree": ("member_id", "degree"), "cardinality": ("edge_id", "cardinality")}[view]
            delta = batch.groupBy(key).agg(F.sum("delta").alias(name))
            new = views.refreshed(old, delta, key, name) if old is not None else delta.where(F.col(name) != 0)
        _publish(new, folder, number)

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
