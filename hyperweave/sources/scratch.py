"""Tables that end a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Bytes of input of which a task gets a share, and from which a size is the planner's word for not knowing.
SHARE, UNKNOWN = 16 << 20, 1 << 50


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that `df` reads, each time that it reads them; what isn't known counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < UNKNOWN)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt out by keys to a number of tasks that grows with the input, so that what one task holds doesn't."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // SHARE), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table under spark.checkpoint.dir; a folder of our own only where none is named and all is one process."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hyperweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    target = f"{path.rstrip('/')}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)
