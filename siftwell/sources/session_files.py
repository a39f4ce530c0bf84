"""Session files: one JSON object a session, as an upload leaves them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = "sessionId string, createdAt string, photos array<struct<id: string, name: string, type: string, size: bigint>>, finalized boolean"


def read_session_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, session_id, created_at, finalized, photos, broken): a row for each file below path.

    A file that is no JSON object, or whose fields are of other types, or that names no session, is broken and has no session: it
    neither stops the others nor counts as an empty one.
    """
    raw = (
        spark.read.schema(f"{SESSION}, broken string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    )
    bad = F.col("broken").isNotNull() | F.col("sessionId").isNull() | F.col("photos").isNull()
    keep = lambda c: F.when(~bad, c)
    return raw.select(
        F.col("_metadata.file_path").alias("path"), keep(F.col("sessionId")).alias("session_id"), keep(F.try_to_timestamp("createdAt")).alias("created_at"),
        keep(F.coalesce("finalized", F.lit(False))).alias("finalized"), keep(F.col("photos")).alias("photos"), bad.alias("broken"),
    )


def sessions_of(files: DataFrame) -> DataFrame:
    """(session_id, created_at, finalized, photos) of the files that hold a session."""
    return files.where("not broken").select("session_id", "created_at", "finalized", "photos")


def session_photos(files: DataFrame) -> DataFrame:
    """(session_id, position, id, name, type, size): the photos of readable files, in their order."""
    rows = files.where("not broken").select("session_id", F.posexplode("photos").alias("position", "photo"))
    return rows.select("session_id", "position", "photo.*")
