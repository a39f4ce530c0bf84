"""Kept state: preferences, byte budget, upload chunks, session tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import DEFAULT, Params
from ..sources.tables import materialise


def upsert_preferences(stored: DataFrame, batch: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(session_id, updated_at, liked, rejected): a session's batch replaces its older one; the newest ten stay.

    At most 20 vectors a side are kept; a batch without any removes the session's.
    """
    cut = lambda c: F.slice(F.coalesce(c, F.array()), 1, p.max_per_batch).alias(c)
    new = batch.select("session_id", "updated_at", cut("liked"), cut("rejected"))
    rest = stored.join(new.select("session_id"), "session_id", "left_anti").select(*new.columns)
    every = rest.unionByName(new.where("size(liked) + size(rejected) > 0"))
    return every.orderBy(F.col("updated_at").desc(), "session_id").limit(p.max_batches)


def remembered_counts(preferences: DataFrame) -> DataFrame:
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias(c)
    return preferences.agg(size("liked"), size("rejected"), F.count("*").alias("batches"))


def exemplars(preferences: DataFrame, side: str) -> DataFrame:
    """(session_id, place, embedding) of one side, newest batch first."""
    order = F.struct((-F.col("updated_at")).alias("age"), "session_id", "i").alias("place")
    return preferences.select("session_id", "updated_at", F.posexplode(side).alias("i", "embedding")).select("session_id", order, "embedding")


def budgeted(selected: DataFrame, budget: Column, p: Params = DEFAULT, files_per_task: int = 100_000) -> DataFrame:
    """(session_id, photo_id): walks a session's files in order of pick; one larger than what is left is skipped.

    A session with more than ``files_per_task`` files is walked in rounds: sums over parts of its order, and within them, take the longest run that
    fits; the next files_per_task of the files that still can fit are walked in one task; then all files larger than
    what is left are out.
    """
    files = materialise(selected.select("session_id", "photo_id", "pick", F.col("size").cast("long").alias("size"), budget.cast("long").alias("budget")))
    large = files.groupBy("session_id").agg(F.count("*").alias("n"), F.max("budget").alias("left")).where(F.col("n") > files_per_task)
    order = ["pick", "size", "photo_id"]
    if large.isEmpty():
        return _walked(files)
    few = _walked(files.join(large.select("session_id"), "session_id", "left_anti"))
    # A part is a stretch of the order; place is a file's number in it.
    parts = materialise(files.join(large.select("session_id"), "session_id", "left_semi").repartitionByRange("session_id", *order).withColumn("part", F.spark_partition_id()))
    rest = materialise(parts.withColumn("place", F.row_number().over(Window.partitionBy("session_id", "part").orderBy(*order))).select("session_id", "photo_id", "size", F.struct("part", "place").alias("at")))
    state = materialise(large.select("session_id", "left", F.lit(None).cast(rest.schema["at"].dataType).alias("done")))
    kept = None
    while True:
        live = rest.join(state, "session_id").where("size <= left and (done is null or at > done)")
        if live.isEmpty():
            return few.unionByName(kept) if kept is not None else few
        sums = live.groupBy("session_id", "at.part").agg(F.sum("size").alias("total"))
        before = sums.withColumn("before", F.sum("total").over(Window.partitionBy("session_id").orderBy("part")) - F.col("total")).drop("total")
        within = F.sum("size").over(Window.partitionBy("session_id", "part").orderBy("at"))
        upto = live.withColumn("part", F.col("at.part")).join(before, ["session_id", "part"]).withColumn("upto", F.col("before") + within)
        run = materialise(upto.select("session_id", "photo_id", "size", "at", (F.col("upto") <= F.col("left")).alias("fits")))
        ends = run.groupBy("session_id").agg(F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("took"), F.min(F.when(~F.col("fits"), F.col("at"))).alias("stop"))
        now = state.join(ends.where("stop is not null"), "session_id").select("session_id", (F.col("left") - F.col("took")).alias("left"), "stop")
        first = Window.partitionBy("session_id").orderBy("at")
        ahead = run.where("not fits").join(now, "session_id").where("size <= left and at > stop").withColumn("i", F.row_number().over(first)).where(F.col("i") <= files_per_task)
        walked = materialise(ahead.select("session_id", "photo_id", "size", "left", "i", F.col("at.part").alias("part"), F.col("at.place").alias("place")).groupBy("session_id").applyInPandas(_walk, "session_id long, photo_id long, left long, part int, place int"))
        taken = run.where("fits").select("session_id", "photo_id").unionByName(walked.where("photo_id is not null").select("session_id", "photo_id"))
        kept = taken if kept is None else kept.unionByName(taken)
        # Where the task saw no file, none is left that could fit.
        state = materialise(walked.where("photo_id is null").select("session_id", "left", F.struct("part", "place").alias("done")))


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The files that fit one after another, and a last row with what is left and the last file seen."""
    pdf, out = pdf.sort_values("i"), []
    session, left = int(pdf["session_id"].iloc[0]), int(pdf["left"].iloc[0])
    for photo, size in zip(pdf["photo_id"].tolist(), pdf["size"].tolist(), strict=True):
        if size <= left:
            left -= size
            out.append((session, photo, None, None, None))
    out.append((session, None, left, int(pdf["part"].iloc[-1]), int(pdf["place"].iloc[-1])))
    return pd.DataFrame(out, columns=["session_id", "photo_id", "left", "part", "place"]).astype({"photo_id": "Int64", "left": "Int64", "part": "Int32", "place": "Int32"})


def _walked(files: DataFrame) -> DataFrame:
    step = lambda s, x: F.struct(
        F.when(x["size"] <= s["left"], s["left"] - x["size"]).otherwise(s["left"]).alias("left"),
        F.when(x["size"] <= s["left"], F.array_append(s["ids"], x["photo_id"])).otherwise(s["ids"]).alias("ids"),
    )
    lists = files.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pick", "size", "photo_id"))).alias("files"), F.max("budget").alias("budget"))
    start = F.struct(F.col("budget").alias("left"), F.array().cast("array<bigint>").alias("ids"))
    return lists.select("session_id", F.explode(F.aggregate("files", start, step, lambda s: s["ids"])).alias("photo_id"))


def upload_chunks(photos: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds the chunk of five and whether it is the session's last."""
    chunk = F.floor(F.col("upload_idx") / p.upload_chunk)
    return photos.withColumn("chunk", chunk).withColumn("is_last", chunk == F.max(chunk).over(Window.partitionBy("session_id")))


def session_summary(scored: DataFrame, groups: DataFrame, unanalysed: DataFrame | None = None, originals: DataFrame | None = None) -> DataFrame:
    """One row a session: photos, rejected, burst groups, collapsed and unanalysed photos, whether steering and saving are possible.

    unanalysed and originals: (session_id, photo_id) of photos without metrics, and of those whose file is at hand.
    """
    base = scored.groupBy("session_id").agg(F.count("*").alias("total"), F.count("rejected_for").alias("rejected"), F.bool_or(F.col("embedding").isNotNull()).alias("steerable"))
    per = groups.groupBy("session_id", "leader_id").agg((F.count("*") - 1).alias("more"))
    bursts = per.groupBy("session_id").agg(F.count_if(F.col("more") > 0).alias("burst_groups"), F.sum("more").alias("collapsed"))
    out = base.join(bursts, "session_id", "left")
    for rows, name in ((unanalysed, "unanalysed"), (originals, "saveable")):
        if rows is not None:
            out = out.join(rows.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if unanalysed is not None:
        out = out.withColumn("total", F.col("total") + F.col("unanalysed"))
    return out.withColumn("saveable", F.col("saveable") > 0).withColumnRenamed("saveable", "can_save") if originals is not None else out


def top_up(selected: DataFrame, unanalysed: DataFrame, totals: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Unanalysed photos (session_id, photo_id, upload_idx) that fill a selection up to the size for all photos."""
    have = selected.groupBy("session_id").agg(F.count("*").alias("have"))
    w = Window.partitionBy("session_id").orderBy("upload_idx")
    x = unanalysed.join(totals, "session_id").join(have, "session_id", "left").withColumn("i", F.row_number().over(w))
    return x.where(F.col("i") <= S.selection_size(F.col("total"), p) - F.coalesce("have", F.lit(0))).select("session_id", "photo_id", "upload_idx")
