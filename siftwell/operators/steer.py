"""Steering: tap toggles, mean embeddings, taste, steered selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.pairs import vectors
from ..params import DEFAULT, Params
from ..sources.tables import materialise
from .select import content_baseline, diverse_top_k


def steering_state(taps: DataFrame) -> DataFrame:
    """(session_id, photo_id, action) after all taps: the same action twice withdraws, another one switches.

    So the state is the last action if the run of it at the end is of odd length, else none.
    """
    w = Window.partitionBy("session_id", "photo_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = taps.withColumn("last", F.last("action").over(whole)).withColumn("i", F.row_number().over(w))
    ends = last.groupBy("session_id", "photo_id", "last").agg(F.max("i").alias("n"), F.max(F.when(F.col("action") != F.col("last"), F.col("i"))).alias("other"))
    return ends.where((F.col("n") - F.coalesce("other", F.lit(0))) % 2 == 1).select("session_id", "photo_id", F.col("last").alias("action"))


def mean_embedding(rows: DataFrame, keys: list[str], order: str = "photo_id") -> DataFrame:
    """keys -> unit vector of the mean of embeddings (those as long as the first in order), null if it is zero."""
    some = rows.where("embedding is not null")
    first = some.groupBy(*keys).agg(F.min_by(F.size("embedding"), order).alias("dims"))
    alike = some.join(first, keys).where(F.size("embedding") == F.col("dims"))
    # A task adds up its vectors; one vector for each task and key is shuffled.
    means = alike.groupBy(*keys).agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    return means.select(*keys, S.unit(vector_to_array("m")).alias("mean"))


def labelled(photos: DataFrame, state: DataFrame) -> DataFrame:
    """Embeddings of liked and rejected photos: (session_id, photo_id, action, embedding)."""
    return photos.join(state, ["session_id", "photo_id"]).select("session_id", "photo_id", "action", "embedding").where("embedding is not null")


def taste_direction(labels: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(session_id, vector, confidence) from unit means of both sides; needs three labels of each."""
    counts = labels.groupBy("session_id").pivot("action", ["like", "reject"]).count().na.fill(0)
    n = F.least("like", "reject")
    counts = counts.select("session_id", n.alias("n")).where(F.col("n") >= p.taste_min_labels)
    means = mean_embedding(labels, ["session_id", "action"])
    side = lambda a, into: means.where(F.col("action") == a).select("session_id", F.col("mean").alias(into))
    both = counts.join(side("like", "kept"), "session_id").join(side("reject", "dropped"), "session_id").where(F.size("kept") == F.size("dropped"))
    vector = S.unit(F.zip_with("kept", "dropped", lambda a, b: a - b))
    return both.select("session_id", vector.alias("vector"), F.least(S.num(1), F.col("n") / S.num(p.taste_confident)).alias("confidence")).where("vector is not null")


def taste_bias(p: Params = DEFAULT):
    """Column over embedding, vector and confidence; 0 where one is missing."""
    strength = S.clamp(S.dot(F.col("embedding"), F.col("vector")) / S.num(p.taste_scale), -1, 1)
    return F.coalesce(S.num(p.taste_weight) * F.col("confidence") * strength, S.num(0))


def nearest_affinity(photos: DataFrame, references: DataFrame, into: str, p: Params = DEFAULT, block: int = 1000) -> DataFrame:
    """Adds the largest remapped cosine to the session's references (session_id, reference), 0 without any.

    Blocks of photos meet blocks of references as matrix products; equal references count once.
    """
    refs = references.where("reference is not null").select("session_id", "reference").distinct()
    own = photos.where("embedding is not null").select("session_id", "photo_id", "embedding")
    chunks = lambda x, name: x.groupBy("session_id").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = materialise(chunks(refs, "theirs").join(chunks(own, "ours"), "session_id"))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    left = own.join(sizes, "session_id").select("session_id", "photo_id", "embedding", F.pmod(F.xxhash64("photo_id"), "ours").cast("int").alias("a"), spread("theirs", "b"))
    # Both sides may come from one table; so the keys are named anew.
    right = refs.join(sizes, "session_id").select(F.col("session_id").alias("session_id"), "reference", F.pmod(F.xxhash64("reference"), "theirs").cast("int").alias("b"), spread("ours", "a"))

    def run(rows: pd.DataFrame, against: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(against):
            return pd.DataFrame({"session_id": [], "photo_id": [], "cosine": []})
        (x, n), (y, m) = vectors(rows["embedding"]), vectors(against["reference"])
        width = max(x.shape[1], y.shape[1])
        product = np.pad(x, ((0, 0), (0, width - x.shape[1]))) @ np.pad(y, ((0, 0), (0, width - y.shape[1]))).T
        # Vectors of another length are unlike: a cosine of 0.
        return pd.DataFrame({"session_id": rows["session_id"], "photo_id": rows["photo_id"], "cosine": np.where(n[:, None] == m, product, 0.0).max(1)})

    keys = ["session_id", "a", "b"]
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "session_id long, photo_id long, cosine double")
    best = each.groupBy("session_id", "photo_id").agg(S.remapped(F.max("cosine"), p).alias(into))
    return photos.join(best, ["session_id", "photo_id"], "left").withColumn(into, F.coalesce(into, S.num(0)))


def steered_taste(labels: DataFrame, remembered: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """taste_direction of a session's labels (session_id, photo_id, action, embedding) and what it remembers (session_id, place, action, embedding)."""
    # A session's own labels stand before what is remembered.
    order = lambda df, own, at: df.select("session_id", "action", "embedding", F.struct(F.lit(own).alias("own"), F.col(at).cast("long").alias("at")).alias("photo_id"))
    return taste_direction(order(labels, 0, "photo_id").unionByName(order(remembered, 1, "place")), p)


def nothing_remembered(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "session_id long, place long, action string, embedding array<float>")


def references_of(labels: DataFrame, action: str) -> DataFrame:
    return labels.where((F.col("action") == action) & F.col("embedding").isNotNull()).select("session_id", F.col("embedding").alias("reference"))


def steered_selection(ranked: DataFrame, state: DataFrame, weights: list[float], bias: float, remembered: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """(session_id, photo_id, pick): liked photos first, then diverse picks under likes, rejects and taste.

    remembered: (session_id, place, action, embedding) of other sessions' exemplars that count for a session.
    """
    remembered = remembered if remembered is not None else nothing_remembered(ranked.sparkSession)
    acted = materialise(ranked.join(state, ["session_id", "photo_id"], "left"))
    pool = acted.where("action is null or action = 'like'")
    labels = acted.where("action is not null").select("session_id", "photo_id", "action", "embedding").where("embedding is not null")
    taste = steered_taste(labels, remembered, p)
    base = content_baseline(pool, weights, bias, p)
    liked = mean_embedding(labels.where("action = 'like'"), ["session_id"])
    x = nearest_affinity(pool, references_of(labels, "reject"), "unwanted", p)
    x = nearest_affinity(x, references_of(remembered, "reject"), "remembers_no", p)
    x = nearest_affinity(x, references_of(remembered, "like"), "remembers_yes", p)
    x = x.join(taste, "session_id", "left").join(base, "session_id", "left").join(liked, "session_id", "left")
    damping = F.least(S.num(1), F.greatest(S.num(p.personal_displaces) * F.coalesce("confidence", S.num(0)), F.col("remembers_yes"), F.col("remembers_no")))
    prior = S.content_bias(S.content_score(F.col("embedding"), weights, bias), F.col("median"), damping, p)
    value = F.col("score") - S.num(p.reject_weight) * F.col("unwanted") - S.num(p.remembered_reject_weight) * F.col("remembers_no") + taste_bias(p) + prior
    asked = F.coalesce(S.remapped(S.dot(F.col("embedding"), F.col("mean")), p), S.num(0))
    discount = S.num(1) - F.greatest(S.num(p.like_relief) * asked, S.num(p.remembered_like_relief) * F.col("remembers_yes"))
    x = x.withColumn("seed", F.coalesce(F.col("action") == "like", F.lit(False)))
    sizes = x.groupBy("session_id").agg(F.greatest(S.selection_size(F.count("*"), p), F.count_if("seed")).alias("k"))
    x = x.join(sizes, "session_id").withColumn("value", value).withColumn("discount", discount)
    return diverse_top_k(x, F.col("k"), F.col("value"), F.col("discount"), seeds=x, p=p)


def review_pool(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """The photos that steering chooses from: representatives that pass, or all photos of a session without any."""
    leaders = groups.where("rank_in_group = 0").select("session_id", "photo_id", F.lit(True).alias("leads"))
    x = ranked.join(leaders, ["session_id", "photo_id"], "left").withColumn("leads", F.col("leads").isNotNull() & F.col("rejected_for").isNull())
    some = x.where("leads").select("session_id", F.lit(True).alias("any")).distinct()
    return x.join(some, "session_id", "left").where("leads or any is null").drop("leads", "any")


def remembered_for(session_id: int, preferences: DataFrame) -> DataFrame:
    """(session_id, place, action, embedding): the stored exemplars of all sessions but the one at hand, newest batch first."""
    others = preferences.where(F.col("session_id") != session_id)
    sides = [others.select("updated_at", F.col("session_id").alias("owner"), F.lit(a).alias("action"), F.posexplode(c).alias("i", "embedding")) for a, c in (("like", "liked"), ("reject", "rejected"))]
    order = Window.partitionBy("action").orderBy(F.col("updated_at").desc(), "owner", "i")
    return sides[0].unionByName(sides[1]).select(F.lit(session_id).cast("long").alias("session_id"), F.row_number().over(order).cast("long").alias("place"), "action", "embedding")


def remembered_by(sessions: DataFrame, preferences: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(session_id, place, action, embedding) for every session: what the newest stored batches of others hold, newest first.

    Params bound these batches and what each holds, so they are broadcast.
    """
    order = Window.partitionBy("action").orderBy(F.col("updated_at").desc(), "owner", "i")
    newest = preferences.orderBy(F.col("updated_at").desc(), "session_id").limit(p.max_batches)
    sides = [newest.select("updated_at", F.col("session_id").alias("owner"), F.lit(a).alias("action"), F.posexplode(F.slice(c, 1, p.max_per_batch)).alias("i", "embedding")) for a, c in (("like", "liked"), ("reject", "rejected"))]
    stored = sides[0].unionByName(sides[1]).select("owner", F.row_number().over(order).cast("long").alias("place"), "action", "embedding")
    own = sessions.select("session_id").distinct()
    return own.join(F.broadcast(stored), F.col("owner") != F.col("session_id")).select("session_id", "place", "action", "embedding")
