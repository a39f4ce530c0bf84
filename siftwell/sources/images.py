"""Image files: their relation, their pixels and their capture times."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .headers import EXIF_BYTES, PhotoHeaders, exif_time
from .tables import small_batches

def _relation(files: DataFrame, *more: str) -> DataFrame:
    """(session_id, upload_idx, id, name, type, size, path, more) of files (path, size, more): a session for each folder, in order of their names."""
    name, ending = F.element_at(F.split("path", "/"), -1), F.lower(F.element_at(F.split("path", r"\."), -1))
    kind = F.when(ending.isin("png", "gif", "bmp", "webp"), F.concat(F.lit("image/"), ending))
    w = Window.partitionBy("session_id").orderBy("path")
    x = files.withColumn("session_id", F.element_at(F.split("path", "/"), -2)).withColumn("upload_idx", F.row_number().over(w) - 1)
    return x.select("session_id", "upload_idx", F.format_string("p%04d", "upload_idx").alias("id"), S.default_name(name, F.col("upload_idx")).alias("name"), S.default_type(kind).alias("type"), "size", "path", *more)


def photo_files(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, upload_idx, id, name, type, size, path): the files below path, none of which is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _relation(files.select("path", F.col("length").alias("size")))


def header_files(spark: SparkSession, path: str, partition_mb: float = 64.0) -> DataFrame:
    """photo_files with taken_at_ms, null without one, and the error of a file that could not be opened. Reads no more than the head of a file."""
    spark.dataSource.register(PhotoHeaders)
    heads = spark.read.format(PhotoHeaders.name()).option("partition_mb", str(partition_mb)).load(path)
    return _relation(heads.withColumn("taken_at_ms", S.exif_epoch_ms(F.col("time"), F.col("zone"))), "taken_at_ms", "error")


def pixels(spark: SparkSession, path: str, edge: int = 512) -> DataFrame:
    """(path, width, height, data): decoded images in rows of r, g, b bytes, the longest edge at most ``edge``; width 0 where decoding failed."""

    def run(batches):
        for batch in batches:
            out = []
            for origin, height, width, channels, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                small = _shrunk(_rgb(width, height, channels, data), edge) if width and width > 0 else np.empty((0, 0, 3), np.uint8)
                out.append((origin, small.shape[1], small.shape[0], small.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["path", "width", "height", "data"])

    small_batches(spark)
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    # Local files are named file:///x by one source and file:/x by the other.
    origin = F.regexp_replace("image.origin", "^file:/+", "file:/").alias("origin")
    return images.select(origin, "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, "path string, width int, height int, data binary")


def _rgb(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    """Spark's images hold blue, green, red (and alpha), or grey."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def _shrunk(rgb: np.ndarray, edge: int) -> np.ndarray:
    """Area averages, aspect kept, at least one pixel a side."""
    height, width = rgb.shape[:2]
    if max(height, width) <= edge:
        return rgb
    for axis, n in enumerate((height, width)):
        m = max(1, int(np.floor(n * edge / max(height, width) + 0.5)))
        starts = np.arange(m) * n // m
        counts = np.diff(np.append(starts, n)).reshape([-1, 1, 1] if axis == 0 else [1, -1, 1])
        rgb = np.add.reduceat(rgb.astype(np.float64), starts, axis=axis) / counts
    return np.floor(rgb + 0.5).astype(np.uint8)


def capture_times(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, taken_at_ms) of files' bytes; null without a time."""

    def run(batches):
        for batch in batches:
            times = [exif_time(c or b"") for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[0] for t in times], pa.string()), pa.array([t[1] for t in times], pa.string())], [key, "time", "zone"])

    heads = files.select(F.col(key), F.substring(content, 1, EXIF_BYTES).alias("content"))
    found = heads.mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, time string, zone string")
    return found.select(key, S.exif_epoch_ms(F.col("time"), F.col("zone")).alias("taken_at_ms"))


def analyse(spark: SparkSession, path: str, edge: int = 512) -> DataFrame:
    """The files' relation with their metrics, capture times and errors (null: measured).

    Names, sizes and capture times come from the files' headers, read as ranges; every image is decoded once, and measured where it was decoded.
    """
    from ..operators.pixel_arrays import measure

    files = header_files(spark, path)
    measured = measure(pixels(spark, path, edge).select(F.xxhash64("path").alias("photo_id"), "path", "width", "height", "data")).drop("photo_id")
    error = F.when(F.col("brightness").isNull(), F.coalesce("error", "unread", F.lit("not an image")))
    return files.withColumnRenamed("error", "unread").join(measured, "path", "left").withColumn("error", error).drop("unread")


def generated_images(spark: SparkSession, ids: DataFrame, width: int = 48, height: int = 40) -> DataFrame:
    """(photo_id, width, height, data): an image drawn by formula for every id."""
    most = max(1, (4 << 20) // (3 * width * height))

    def run(batches):
        x, y = np.meshgrid(np.arange(width), np.arange(height))
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.column(0).slice(lo, most)
                drawn = [np.stack([(x * 7 + y * 3 + k * 31 + (x * y) % 11) % 256, (x * 5 + y * 11 + k * 17) % 256, (x * y + k * 13) % 256], 2).astype(np.uint8).tobytes() for k in part.to_pylist()]
                n = len(drawn)
                yield pa.RecordBatch.from_arrays([part, pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array(drawn, pa.binary())], ["photo_id", "width", "height", "data"])

    small_batches(spark)
    return ids.select(F.col(ids.columns[0]).cast("long").alias("photo_id")).mapInArrow(run, "photo_id long, width int, height int, data binary")

