"""Leader clustering of near-duplicates.

In rank order each photo joins the first leader that it is a near-duplicate of, else it leads.
That is the lexicographically first maximal independent set of the near-duplicate graph, with
every other photo at its earliest neighbouring leader.

Copies that are near-duplicates of themselves have the same neighbours, so the first one stands for all: it alone is compared, and the others go
where it goes. A session whose pairs fit a task is scanned there; a larger one is split into connected
components first, and only a component that is still too large is solved in relational rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import near_duplicate
from ..params import DEFAULT, Params
from ..sources.tables import materialise, shared_path  # noqa: F401
from .duplicates import near_edges

#: Pairs of photos that are scanned in one task.
EDGES_PER_TASK = 1_000_000


def leader_groups(ranked: DataFrame, p: Params = DEFAULT, edges_per_task: int = EDGES_PER_TASK, block: int = 4000) -> DataFrame:
    """(session_id, leader_id, photo_id, rank, rank_in_group); a leader is in its own group at 0."""
    names = ["hash", "color_signature", "taken_at_ms", "embedding"]
    one = F.struct("rank", *names)
    seen = ranked.select("session_id", "rank", "photo_id", *names, one.alias("a"), one.alias("b"))
    # Two 64-bit hashes of all that is compared, and which of it is unknown.
    print_ = F.struct(F.xxhash64(*names), F.xxhash64(F.lit("again"), *names), *[F.col(c).isNull() for c in names])
    photos = materialise(seen.withColumn("copy", F.when(near_duplicate(p=p), F.to_json(print_))).drop("a", "b"))
    first = photos.where("copy is not null").groupBy("session_id", "copy").agg(F.min("rank").alias("first"))
    stands = photos.select("session_id", "rank", "photo_id", "copy").join(first, ["session_id", "copy"], "left").withColumn("first", F.coalesce("first", "rank"))
    stands = materialise(stands.select("session_id", "rank", "photo_id", "first"))
    reps = photos.join(stands.where("first = rank").select("session_id", "rank"), ["session_id", "rank"], "left_semi")
    led = leaders(materialise(near_edges(reps, p, block)), edges_per_task)
    placed = stands.join(led.withColumnRenamed("rank", "first"), ["session_id", "first"], "left").select("session_id", "photo_id", "rank", F.coalesce("leader", "first").alias("lead_rank"))
    heads = stands.select("session_id", F.col("rank").alias("lead_rank"), F.col("photo_id").alias("leader_id"))
    w = Window.partitionBy("session_id", "lead_rank").orderBy("rank")
    return placed.join(heads, ["session_id", "lead_rank"]).select("session_id", "leader_id", "photo_id", "rank", (F.row_number().over(w) - 1).alias("rank_in_group"))


def leaders(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(session_id, rank, leader): every photo that joins another one, by rank; the others lead. edges: a stored table (session_id, lo, hi)."""
    sizes = edges.groupBy("session_id").agg((F.count("*") > edges_per_task).alias("large"))
    if sizes.where("large").isEmpty():
        return _scanned(edges, ["session_id"])
    small = edges.join(sizes.where("not large").select("session_id"), "session_id", "left_semi")
    rest = materialise(edges.join(sizes.where("large").select("session_id"), "session_id", "left_semi"))
    parts = rest.join(components(rest).withColumnRenamed("rank", "lo"), ["session_id", "lo"])
    counts = parts.groupBy("session_id", "component").agg((F.count("*") > edges_per_task).alias("large"))
    parts = materialise(parts.join(counts, ["session_id", "component"]))
    fit = _scanned(parts.where("not large"), ["session_id", "component"])
    return _scanned(small, ["session_id"]).unionByName(fit).unionByName(_in_rounds(parts.where("large").select("session_id", "lo", "hi")))


def _scanned(edges: DataFrame, keys: list[str]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["lo"], pdf["hi"]))
        joins: dict[int, int] = {}
        for lo, hi in zip(pdf["lo"].to_numpy()[order].tolist(), pdf["hi"].to_numpy()[order].tolist(), strict=True):
            if hi not in joins and lo not in joins:  # lo comes before hi, so what it does is known
                joins[hi] = lo
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "rank": list(joins), "leader": list(joins.values())}).astype({"rank": "int32", "leader": "int32"})

    return edges.groupBy(*keys).applyInPandas(run, "session_id long, rank int, leader int")


def components(edges: DataFrame) -> DataFrame:
    """(session_id, rank, component): the smallest rank that can be reached, for every photo with a pair.

    Labels go to neighbours, then a label's own label replaces it, so the rounds grow with the logarithm of the longest way.
    """
    both = materialise(edges.select("session_id", F.col("lo").alias("rank"), F.col("hi").alias("other")).unionByName(edges.select("session_id", F.col("hi").alias("rank"), F.col("lo").alias("other"))))
    labels = materialise(both.groupBy("session_id", "rank").agg(F.least("rank", F.min("other")).alias("component")))
    while True:
        near = both.join(labels.select("session_id", F.col("rank").alias("other"), F.col("component").alias("theirs")), ["session_id", "other"]).groupBy("session_id", "rank").agg(F.min("theirs").alias("theirs"))
        told = labels.join(near, ["session_id", "rank"]).select("session_id", "rank", F.col("component").alias("was"), F.least("component", "theirs").alias("label"))
        onward = labels.select("session_id", F.col("rank").alias("label"), F.col("component").alias("further"))
        moved = materialise(told.join(onward, ["session_id", "label"], "left").select("session_id", "rank", F.least("label", "further").alias("component"), (F.least("label", "further") < F.col("was")).alias("moved")))
        labels = moved.select("session_id", "rank", "component")
        if moved.where("moved").isEmpty():
            return labels


def _in_rounds(edges: DataFrame) -> DataFrame:
    """``leaders`` in rounds of joins: a photo is settled once all its earlier neighbours before its first leader are."""
    state = materialise(edges.select("session_id", F.col("hi").alias("rank")).distinct().select("session_id", "rank", F.lit(None).cast("int").alias("leader")))
    # Whoever has no earlier neighbour leads; state holds the others, with a leader's rank once known (0: leads itself).
    while not state.where("leader is null").isEmpty():
        known = state.select("session_id", F.col("rank").alias("lo"), F.col("leader").alias("their"), F.lit(True).alias("waits"))
        seen = edges.join(known, ["session_id", "lo"], "left")
        leads = F.col("waits").isNull() | (F.col("their") == 0)
        told = seen.groupBy("session_id", F.col("hi").alias("rank")).agg(
            F.min(F.when(leads, F.col("lo"))).alias("first"), F.min(F.when(F.col("waits") & F.col("their").isNull(), F.col("lo"))).alias("open"), )
        now = F.when(F.col("leader").isNotNull(), F.col("leader")).when(F.col("first").isNotNull() & (F.col("open").isNull() | (F.col("first") < F.col("open"))), F.col("first")).when(F.col("first").isNull() & F.col("open").isNull(), F.lit(0))
        state = materialise(state.join(told, ["session_id", "rank"]).select("session_id", "rank", now.cast("int").alias("leader")))
    return state.where("leader > 0")


def alternates(groups: DataFrame) -> DataFrame:
    """(session_id, leader_id, alternates) of groups that have any."""
    return groups.groupBy("session_id", "leader_id").agg((F.count("*") - 1).alias("alternates")).where("alternates > 0")
