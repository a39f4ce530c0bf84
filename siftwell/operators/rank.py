"""Scoring, quality bar, ranking, shortlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import DEFAULT, Params


def score(photos: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds the four part scores, the score and the reject label (null: passes)."""
    parts = photos.select("*", S.focus_score(p).alias("focus_score"), S.exposure_score(p).alias("exposure_score"), S.tone_score().alias("tone_score"), S.color_score().alias("color_score"))
    total = S.num(p.w_focus) * F.col("focus_score") + S.num(p.w_exposure) * F.col("exposure_score") + S.num(p.w_tone) * F.col("tone_score") + S.num(p.w_color) * F.col("color_score")
    return parts.select("*", total.alias("score"), S.reject_label(F.col("focus_score"), p).alias("rejected_for"))


def rank(scored: DataFrame) -> DataFrame:
    """Adds the total order within a session: rounded score, then size, then upload order."""
    order = Window.partitionBy("session_id").orderBy(S.half_up(F.col("score") * 100).desc(), F.col("size").desc(), "upload_idx")
    return scored.withColumn("rank", F.row_number().over(order))


def shortlist(ranked: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The passing photos worth an embedding: max(twice the selection, min(n, 16)) by rank."""
    w = Window.partitionBy("session_id")
    n = F.count("*").over(w)
    passing = ranked.where("rejected_for is null").withColumn("n", n).withColumn("place", F.row_number().over(w.orderBy("rank")))
    most = F.greatest(2 * S.selection_size(F.col("n"), p), F.least(F.col("n"), F.lit(p.shortlist_least)))
    return passing.where(F.col("place") <= most).drop("n")
