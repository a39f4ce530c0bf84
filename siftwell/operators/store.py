"""Stored sessions, preferences and originals: Parquet tables below one folder, and the rules for changing them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

TABLES = {
    "sessions": "session_id long, created_at long, finalized boolean, liked array<long>, rejected array<long>, selected array<long>",
    "preferences": "session_id long, updated_at long, liked array<array<float>>, rejected array<array<float>>",
    "originals": "key string, size long",
    "photos": "session_id long, position int, id string, name string, type string, size long",
}


#: The column whose hash tells a row's bucket.
KEYS = {"sessions": "session_id", "preferences": "session_id", "originals": "key", "photos": "session_id"}


class Store:
    """The tables at a path; one that was never written is empty. A table has one writer at a time.

    A table's rows lie in buckets of their key. A change reads and writes the buckets it touches, in a new folder; then a commit, a small table written last,
    names the folder of every bucket. Readers go by the newest complete commit, so a write that fails leaves the rows as they were.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _commits(self, name: str) -> list[str]:
        """Names of the complete commits, the newest last."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/commits")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        done = [f.getPath() for f in files.listStatus(folder) if files.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return sorted(p.getName() for p in done)

    def _folders(self, name: str) -> dict[int, str]:
        """bucket -> folder, as the newest commit has them; no more rows than buckets."""
        commits = self._commits(name)
        if not commits:
            return {}
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/{name}/commits/{commits[-1]}").collect()
        return {r.bucket: r.folder for r in rows}

    def _of(self, name: str, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/{name}/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(KEYS[name])), F.lit(self.buckets)).cast("int")

    def _put(self, name: str, rows: DataFrame, kept: dict[int, str]) -> None:
        """Writes rows to a new folder and commits its buckets beside those that are kept."""
        folder = f"data-{uuid.uuid4().hex}"
        columns = [f.name for f in self.spark.createDataFrame([], TABLES[name]).schema]
        rows.select(*columns).withColumn("bucket", self._bucket(name)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/{folder}")
        new = self.spark.read.schema(f"{TABLES[name]}, bucket int").parquet(f"{self.path}/{name}/{folder}").select("bucket").distinct()
        named = kept | {r.bucket: folder for r in new.collect()}
        commits = self._commits(name)
        number = int(commits[-1]) + 1 if commits else 0
        self.spark.createDataFrame(sorted(named.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/commits/{number:012d}")

    def read(self, name: str) -> DataFrame:
        return self._of(name, self._folders(name))

    def write(self, name: str, rows: DataFrame) -> None:
        """Replaces a table; the new rows may come from the old ones."""
        self._put(name, rows, {})

    def update(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the buckets of some keys (one column) by what change makes of their rows. What it adds must have keys of these."""
        folders = self._folders(name)
        touched = {r.bucket for r in keys.select(F.col(keys.columns[0]).alias(KEYS[name])).select(self._bucket(name).alias("bucket")).distinct().collect()}
        old = self._of(name, {b: f for b, f in folders.items() if b in touched})
        self._put(name, change(old), {b: f for b, f in folders.items() if b not in touched})

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Puts rows in place of those with the same key."""
        self.update(name, rows.select(KEYS[name]), lambda old: upserted(old, rows, KEYS[name]))

    def clear(self, name: str) -> None:
        """Forgets all rows."""
        self.write(name, self.spark.createDataFrame([], TABLES[name]))

    def session(self, session_id: int) -> DataFrame:
        return self.read("sessions").where(F.col("session_id") == session_id)

    def session_ids(self) -> DataFrame:
        return self.read("sessions").select("session_id").distinct()


def upserted(stored: DataFrame, rows: DataFrame, key: str = "session_id") -> DataFrame:
    """The stored rows, with those of the same key replaced."""
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows)


def only(stored: DataFrame, session_id: int | None) -> DataFrame:
    """Nothing but this session; nothing at all for None."""
    return stored.where(F.col("session_id") == session_id) if session_id is not None else stored.limit(0)


def without(stored: DataFrame, session_id: int) -> DataFrame:
    return stored.where(F.col("session_id") != session_id)


def steered(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions with new taps and selections; changes (session_id, liked, rejected, selected) of unknown sessions count for nothing."""
    names = ("liked", "rejected", "selected")
    new = changes.select("session_id", F.lit(True).alias("changed"), *[F.col(c).alias(f"new_{c}") for c in names])
    x = sessions.join(new, "session_id", "left")
    return x.select(*[F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in sessions.columns])


def finalised(sessions: DataFrame, session_id: int) -> DataFrame:
    """The sessions with this one marked as complete; an unknown one is an error."""
    if sessions.where(F.col("session_id") == session_id).isEmpty():
        raise ValueError(f"unknown session: {session_id}")
    return sessions.withColumn("finalized", F.col("finalized") | (F.col("session_id") == session_id))


def appended(photos: DataFrame, files: DataFrame) -> DataFrame:
    """The photos of sessions with new files (session_id, upload_idx, name, type, size) behind those they have.

    The id tells the position and a suffix that depends on session, position and name.
    """
    have = photos.groupBy("session_id").agg(F.count("*").alias("have"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("upload_idx")) - 1 + F.coalesce("have", F.lit(0))
    x = files.join(have, "session_id", "left").withColumn("position", place.cast("int"))
    suffix = F.substring(F.sha2(F.concat_ws("/", F.col("session_id").cast("string"), F.col("position").cast("string"), F.coalesce("name", F.lit(""))), 256), 1, 6)
    x = x.withColumn("id", F.format_string("p%04d_%s", "position", suffix))
    named = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat("id", F.lit(".jpg")))
    new = x.select("session_id", "position", "id", named.alias("name"), S.default_type(F.col("type")).alias("type"), F.col("size").cast("long").alias("size"))
    return photos.select(*new.columns).unionByName(new)


def originals_of(originals: DataFrame, session_id: int) -> DataFrame:
    """A session's stored originals by photo: keys that begin with it, without that part."""
    prefix = f"{session_id}:"
    rest = F.expr(f"substring(key, {len(prefix) + 1})").alias("photo_id")
    return originals.where(F.col("key").startswith(prefix)).select(rest, *[c for c in originals.columns if c != "key"])


def originals_by_session(originals: DataFrame) -> DataFrame:
    """All stored originals with session and photo as their keys name them, split at the first colon."""
    at = F.locate(":", F.col("key"))
    return originals.select(F.substring("key", F.lit(1), at - 1).cast("long").alias("session_id"), F.substring("key", at + 1, F.length("key")).alias("photo_id"), *[c for c in originals.columns if c != "key"])


def replaced_originals(originals: DataFrame, wanted: DataFrame) -> DataFrame:
    """The originals that are wanted: new ones put in, all others pruned."""
    return upserted(originals, wanted, "key").join(wanted.select("key"), "key", "left_semi")


def looked_up(requests: DataFrame, photos: DataFrame) -> DataFrame:
    """The requests (session_id, id) with the photo each asks for, and a status: ok, missing session id, or not found."""
    found = requests.join(photos.select("session_id", "id", "name", "type", "size", F.lit(True).alias("found")), ["session_id", "id"], "left")
    status = F.when(F.col("session_id").isNull(), "missing session id").when(F.col("found"), "ok").otherwise("not found")
    return found.withColumn("status", status).drop("found")


def session_answers(requests: DataFrame, sessions: DataFrame, photos: DataFrame) -> DataFrame:
    """The requests (session_id) with how many photos the session has and whether it is complete; a status where there is none."""
    n = photos.groupBy("session_id").agg(F.count("*").alias("total"))
    x = requests.join(sessions.select("session_id", "finalized"), "session_id", "left").join(n, "session_id", "left")
    known = F.col("finalized").isNotNull()
    status = F.when(F.col("session_id").isNull(), "missing session id").when(known, "ok").otherwise("unknown session")
    return x.withColumn("status", status).withColumn("total", F.when(known, F.coalesce("total", F.lit(0))))
