"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word; every other character belongs to one.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; local sessions get one of their own where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-siftwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lets few rows at a time cross to Python: texts and sets are long, and a batch of them is held in both processes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/siftwell/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str, codec: str = "zstd", zstd_level: int = 3) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", zstd_level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of the taken ones equals, whatever the case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name
