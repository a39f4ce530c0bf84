"""A reason for every pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.pairs import similarity
from ..params import DEFAULT, Params
from ..sources.tables import materialise
from .cluster import alternates
from .select import content_baseline
from .steer import nearest_affinity, nothing_remembered, references_of, steered_taste, taste_bias

#: The labels shown for reasons.
REASON_LABELS = {
    "kept": "you kept this", "best-of-similar": "best of similar", "like-your-picks": "like your picks",
    "well-composed": "well composed", "top-quality": "top quality", "different-subject": "different subject",
}


def novelty(picks: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds 1 minus the largest similarity to an earlier pick (1 for the first)."""
    side = F.struct("photo_id", "pick", "hash", "color_signature", "taken_at_ms", "embedding")
    a, b = picks.select("session_id", side.alias("a")), picks.select("session_id", side.alias("b"))
    least = a.join(b, "session_id").where("b.pick < a.pick").groupBy("session_id", F.col("a.photo_id").alias("photo_id")).agg(F.min(S.num(1) - similarity(p=p)).alias("novelty"))
    return picks.join(least, ["session_id", "photo_id"], "left").withColumn("novelty", F.coalesce(F.least("novelty", S.num(1)), S.num(1)))


def explain(picks: DataFrame, weights: list[float], bias: float, p: Params = DEFAULT) -> DataFrame:
    """Adds novelty and reason. picks has pick, liked, alternates, remembers_yes, vector, confidence, standout and photo columns (null: unknown)."""
    x = novelty(picks, p)
    good = F.coalesce(S.content_score(F.col("embedding"), weights, bias) >= F.col("standout"), F.lit(False))
    taste = F.col("vector").isNotNull() & (taste_bias(p) >= S.num(p.taste_weight) * F.col("confidence") * S.num(p.clearly_to_taste))
    reason = (
        F.when(F.col("liked"), "kept").when(F.col("alternates") > 0, "best-of-similar")
        .when(taste | (F.col("remembers_yes") >= p.clearly_remembered), "like-your-picks").when(good, "well-composed")
        .when((F.col("pick") == 0) | (F.col("novelty") < p.novel_enough), "top-quality").otherwise("different-subject")
    )
    return x.withColumn("reason", reason)


def explain_selection(pool: DataFrame, picks: DataFrame, state: DataFrame, groups: DataFrame, weights: list[float], bias: float, remembered: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """Novelty and reason of the picks (session_id, photo_id, pick) that a review shows.

    pool: the photos chosen from, dropped ones included; taste and content baseline count over all of them. state: (session_id, photo_id,
    action); groups: of near-duplicates; remembered: as in steered_selection.
    """
    remembered = remembered if remembered is not None else nothing_remembered(pool.sparkSession)
    acted = materialise(pool.join(state, ["session_id", "photo_id"], "left"))
    labels = acted.where("action is not null and embedding is not null").select("session_id", "photo_id", "action", "embedding")
    shown = materialise(picks.select("session_id", "photo_id", "pick").join(acted, ["session_id", "photo_id"]))
    x = nearest_affinity(shown, references_of(remembered, "like"), "remembers_yes", p)
    x = x.join(alternates(groups).withColumnRenamed("leader_id", "photo_id"), ["session_id", "photo_id"], "left").withColumn("alternates", F.coalesce("alternates", F.lit(0)))
    x = x.join(steered_taste(labels, remembered, p), "session_id", "left").join(content_baseline(pool, weights, bias, p), "session_id", "left")
    return explain(materialise(x.withColumn("liked", F.coalesce(F.col("action") == "like", F.lit(False)))), weights, bias, p)


def reason_label(reason: Column, alternates: Column) -> Column:
    plain = F.create_map(*[F.lit(x) for kv in REASON_LABELS.items() for x in kv])[reason]
    return F.when((reason == "best-of-similar") & (alternates > 0), F.concat(F.lit("best of "), (alternates + 1).cast("string"))).otherwise(plain)
