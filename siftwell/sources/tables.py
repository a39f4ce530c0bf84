"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share; local sessions get one of their own where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-siftwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siftwell/{tag}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Lets few MB at a time cross to Python: images are long, and each worker of an executor holds a batch in several forms."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8MB")


def materialise(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
