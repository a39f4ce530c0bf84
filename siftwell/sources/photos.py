"""The photo relation: one row a photo, keyed by session_id and upload_idx."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = (
    "sharpness", "center_sharpness", "focus", "noise_ratio", "contrast", "brightness",
    "clipped_highlights", "clipped_shadows", "dynamic_range", "colorfulness",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos derived from embeddings, documents and events of equal id (the tables hold no images)."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    # Texts are hashed where they are read, so none is shuffled.
    d = read(spark, sf_dir, "documents").selectExpr("doc_id as vec_id", "n_chars", "concat(substr(sha2(source, 256), 1, 56), substr(sha2(text, 256), 1, 8)) as text_hash")
    v = read(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    x = e.join(d, "vec_id").join(v, "vec_id").withColumnRenamed("vec_id", "k")
    return x.selectExpr(
        "cast(floor(k / 250) as bigint) as session_id",
        "cast(k % 250 as int) as upload_idx",
        "k as photo_id",
        "n_chars * 1000 as size",
        "case when k % 7 <> 0 then 1704067200000 + cast(floor((ms - 1704067200000) / 300) as bigint) end as taken_at_ms",
        "case when k % 3 <> 0 then embedding end as embedding",
        "case when k % 50 = 0 then repeat('f', 64) else text_hash end as hash",
        "transform(sequence(0, 31), i -> cast(60 + (label * 17 + i * 5) % 60 + k % 4 as int)) as color_signature",
        "cast(1 + k * 37 % 100 as double) as sharpness",
        "cast(1 + k * 37 % 100 as double) as center_sharpness",
        "0.005D + (k * 53 % 97) / 400D as focus",
        "0.5D + (k * 29 % 41) / 10D as noise_ratio",
        "cast(5 + k * 17 % 61 as double) as contrast",
        "cast(20 + k * 43 % 221 as double) as brightness",
        "(k * 31 % 89) / 300D as clipped_highlights",
        "(k * 23 % 83) / 310D as clipped_shadows",
        "cast(30 + k * 19 % 151 as double) as dynamic_range",
        "cast(5 + k * 13 % 59 as double) as colorfulness",
    )


def content_head(dims: int = 64) -> tuple[list[float], float]:
    """A deterministic linear head (weights, bias)."""
    return [((i * 37) % 64 - 32) / 16.0 for i in range(dims)], 5.0


def tap_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, photo, action, ts, event_id): like and reject taps derived from the events."""
    action = F.when(F.col("event_type").isin("click", "purchase"), "like").when(F.col("event_type") == "error", "reject")
    v = read(spark, sf_dir, "events").withColumn("action", action).where("action is not null")
    return v.select((F.col("user_id") % 10).alias("session_id"), (F.col("event_id") % 20).alias("photo_id"), "action", "ts", "event_id")
