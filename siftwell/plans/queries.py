"""Registered queries of the curation engine: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pairs as P
from ..functions import scalars as S
from ..operators import cluster, duplicates, explain, pixel_arrays, rank, select, state, steer
from ..params import Params
from ..sources import images
from ..sources import photos as src

#: The derived vectors are far apart; so the queries take vectors at this cosine as one subject.
QUERY = Params(same_subject=0.35)
W, BIAS = src.content_head()


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ranked(spark, d) -> DataFrame:
    return rank.rank(rank.score(src.derived_photos(spark, d), QUERY))


def entry(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_session(spark, d)


def score_photos(spark, d):
    s = rank.score(src.derived_photos(spark, d), QUERY)
    return s.select("session_id", "photo_id", *[r6(c).alias(c) for c in ("focus_score", "exposure_score", "tone_score", "color_score", "score")], "rejected_for")


def reject_counts(spark, d):
    s = rank.score(src.derived_photos(spark, d), QUERY)
    return s.groupBy("session_id", F.coalesce("rejected_for", F.lit("passes")).alias("outcome")).agg(F.count("*").alias("n"))


def selection_sizes(spark, d):
    """For all counts that the tables have: events of a user, lines of an order, documents of a source, photos of a session."""
    counts = lambda name, *keys: src.read(spark, d, name).groupBy(*keys).agg(F.count("*").alias("total")).select("total")
    totals = counts("events", "user_id").union(counts("lineitem", "l_orderkey")).union(counts("documents", "source")).union(counts("lineitem", "l_returnflag", "l_linenumber"))
    return totals.distinct().select("total", S.selection_size(F.col("total")).alias("wanted"))


def rank_photos(spark, d):
    return ranked(spark, d).select("session_id", "photo_id", "rank")


def top_n_per_session(spark, d):
    return ranked(spark, d).where("rejected_for is null and rank <= 50").select("session_id", "photo_id", "rank", r6("score").alias("score"))


def embedding_shortlist(spark, d):
    return rank.shortlist(ranked(spark, d)).select("session_id", "photo_id", "place")


def hash_popcount_degenerate(spark, d):
    return src.derived_photos(spark, d).select("photo_id", S.ones(F.col("hash")).alias("ones"), S.degenerate(F.col("hash")).alias("degenerate"))


def pair_distances(spark, d):
    x = P.session_pairs(ranked(spark, d))
    return x.select("session_id", F.col("a.photo_id").alias("a"), F.col("b.photo_id").alias("b"), S.hamming(F.col("a.hash"), F.col("b.hash")).alias("bits"), r6(S.color_distance(F.col("a.color_signature"), F.col("b.color_signature"))).alias("color")).where("bits <= 48")


def embedding_pairs(spark, d):
    x = P.session_pairs(ranked(spark, d).where("embedding is not null"))
    return x.select("session_id", F.col("a.photo_id").alias("a"), F.col("b.photo_id").alias("b"), r6(S.dot(F.col("a.embedding"), F.col("b.embedding"))).alias("cosine")).where("cosine >= 0.3")


def near_duplicate_pairs(spark, d):
    r = ranked(spark, d)
    side = lambda rank, into: r.select("session_id", F.col("rank").alias(rank), F.col("photo_id").alias(into))
    return duplicates.near_edges(r, QUERY, block=200).join(side("lo", "a"), ["session_id", "lo"]).join(side("hi", "b"), ["session_id", "hi"]).select("session_id", "a", "b")


def pair_similarity(spark, d):
    x = P.session_pairs(ranked(spark, d)).select("session_id", F.col("a.photo_id").alias("photo_id"), P.similarity().alias("s"))
    # Nine digits: the steps of this value end there, so none of them lies on a tie.
    return x.groupBy("session_id", "photo_id").agg(F.round(F.max("s"), 9).alias("nearest"), F.count("*").alias("later"))


def content_scores(spark, d):
    return src.derived_photos(spark, d).select("photo_id", r6(S.content_score(F.col("embedding"), W, BIAS)).alias("content"), S.content_score(F.col("embedding"), W[:32], BIAS).alias("other_length"))


def content_baseline(spark, d):
    b = select.content_baseline(ranked(spark, d), W, BIAS)
    return b.select("session_id", r6("median").alias("median"), r6("standout").alias("standout"))


def exif_epoch_ms(spark, d):
    v = src.read(spark, d, "events").withColumn("t", F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    zone = F.when(F.col("event_id") % 5 == 0, "-07:00").when(F.col("event_id") % 5 == 1, " +05:30 ").when(F.col("event_id") % 5 == 2, "+05:30x")
    text = F.when(F.col("event_id") % 11 == 0, "not a date").otherwise(F.concat(F.lit(" "), "t", F.lit(" x")))
    return v.select("event_id", S.exif_epoch_ms(text, zone).alias("ms"))


def file_name_repair(spark, d):
    c = src.read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(".JPeG"))).otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "image/png").otherwise("image/jpeg").alias("mime"))
    return c.select("p_partkey", S.sane_file_name(F.col("name"), F.col("mime")).alias("file_name"))


def duplicate_groups(spark, d):
    return cluster.leader_groups(ranked(spark, d), QUERY).select("session_id", "leader_id", "photo_id", "rank_in_group")


def group_alternates(spark, d):
    return cluster.alternates(cluster.leader_groups(ranked(spark, d), QUERY))


def diverse_top_k(spark, d):
    pool = ranked(spark, d).where("rejected_for is null")
    return select.diverse_top_k(pool, F.lit(25), F.col("score"), p=QUERY)


def best_photos(spark, d):
    return select.best_photos(src.derived_photos(spark, d), W, BIAS, QUERY).select("session_id", "photo_id", "pick")


def _taps(spark, d) -> DataFrame:
    """Tap states whose photos are upload positions of the sessions at hand."""
    s = steer.steering_state(src.tap_log(spark, d))
    at = src.derived_photos(spark, d).select("session_id", "upload_idx", F.col("photo_id").alias("pid"))
    return s.join(at, (at["session_id"] == s["session_id"]) & (at["upload_idx"] == s["photo_id"])).select(s["session_id"], F.col("pid").alias("photo_id"), "action")


def steering_state(spark, d):
    return steer.steering_state(src.tap_log(spark, d))


def mean_embedding(spark, d):
    m = steer.mean_embedding(src.derived_photos(spark, d).select("session_id", "photo_id", "embedding"), ["session_id"])
    return m.select("session_id", F.posexplode("mean").alias("i", "x")).select("session_id", "i", F.round("x", 5).alias("x"))


def taste_direction(spark, d):
    t = steer.taste_direction(steer.labelled(src.derived_photos(spark, d), _taps(spark, d)))
    return t.select("session_id", r6("confidence").alias("confidence"), F.posexplode("vector").alias("i", "x")).select("session_id", "confidence", "i", F.round("x", 5).alias("x"))


def taste_biases(spark, d):
    photos = src.derived_photos(spark, d)
    t = steer.taste_direction(steer.labelled(photos, _taps(spark, d)))
    return photos.join(t, "session_id", "left").select("session_id", "photo_id", F.round(steer.taste_bias(), 5).alias("bias"))


def nearest_affinity(spark, d):
    """How near every photo of a session is to those that fail the bar."""
    photos = ranked(spark, d)
    refs = photos.where("rejected_for is not null and embedding is not null").select("session_id", F.col("embedding").alias("reference"))
    return steer.nearest_affinity(photos, refs, "nearest").select("session_id", "photo_id", r6("nearest").alias("nearest"))


def steered_selection(spark, d):
    r = ranked(spark, d)
    return steer.steered_selection(steer.review_pool(r, cluster.leader_groups(r, QUERY)), _taps(spark, d), W, BIAS, p=QUERY)


def _review(spark, d):
    """Ranked photos, their groups, the pool of a review, and what each session remembers of others."""
    r = cluster.materialise(ranked(spark, d))
    groups = cluster.materialise(cluster.leader_groups(r, QUERY))
    pool = cluster.materialise(steer.review_pool(r, groups))
    return groups, pool, cluster.materialise(steer.remembered_by(r, _preferences(spark, d)))


def steered_with_memory(spark, d):
    """Selections steered by a session's taps and by what other sessions liked and rejected."""
    _, pool, remembered = _review(spark, d)
    return steer.steered_selection(pool, _taps(spark, d), W, BIAS, remembered, QUERY)


def _explained(spark, d) -> DataFrame:
    """The steered selections' picks, explained."""
    groups, pool, remembered = _review(spark, d)
    taps = _taps(spark, d)
    picks = steer.steered_selection(pool, taps, W, BIAS, remembered, QUERY)
    return explain.explain_selection(pool, picks, taps, groups, W, BIAS, remembered, QUERY)


def pick_novelty(spark, d):
    return _explained(spark, d).select("session_id", "photo_id", "pick", r6("novelty").alias("novelty"))


def pick_reasons(spark, d):
    return _explained(spark, d).select("session_id", "photo_id", "pick", "reason", explain.reason_label(F.col("reason"), F.col("alternates")).alias("label"))


def budgeted_originals(spark, d):
    r = ranked(spark, d).withColumn("pick", F.col("rank"))
    return state.budgeted(r, F.lit(20_000_000))


def upload_chunks(spark, d):
    return state.upload_chunks(src.derived_photos(spark, d)).select("session_id", "photo_id", "chunk", "is_last")


def session_summary(spark, d):
    r = ranked(spark, d)
    return state.session_summary(r, cluster.leader_groups(r, QUERY))


def _preferences(spark, d) -> DataFrame:
    """Stored batches derived from the photos: 16 batches of liked and rejected vectors."""
    p = src.derived_photos(spark, d).where("embedding is not null").withColumn("batch", F.col("photo_id") % 16).withColumn("side", F.when(F.col("photo_id") % 5 < 3, "liked").otherwise("rejected"))
    lists = p.groupBy("batch").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("photo_id", "embedding")))), lambda x: x["embedding"]).alias(s) for s in ("liked", "rejected")])
    return lists.select(F.col("batch").alias("session_id"), (F.lit(1000) + F.col("batch") * 7 % 16).alias("updated_at"), "liked", "rejected")


def preference_upsert(spark, d):
    stored = _preferences(spark, d)
    new = stored.where("session_id = 3").select("session_id", F.lit(5000).cast("long").alias("updated_at"), "liked", "rejected")
    return state.upsert_preferences(stored, new).select("session_id", "updated_at", F.size("liked").alias("n_liked"), F.size("rejected").alias("n_rejected"))


def remembered_counts(spark, d):
    return state.remembered_counts(_preferences(spark, d))


def _px(spark, d) -> DataFrame:
    """An image drawn by formula for every photo of the table, measured."""
    return pixel_arrays.measure(images.generated_images(spark, src.read(spark, d, "embeddings").select("vec_id")))


def px_luma_stats(spark, d):
    return _px(spark, d).select("photo_id", *[r6(c).alias(c) for c in ("brightness", "contrast", "clipped_shadows", "clipped_highlights", "dynamic_range")])


def px_focus_noise(spark, d):
    return _px(spark, d).select("photo_id", *[F.round(c, 4).alias(c) for c in ("sharpness", "center_sharpness", "focus", "noise_ratio")])


def px_colorfulness(spark, d):
    return _px(spark, d).select("photo_id", r6("colorfulness").alias("colorfulness"))


def px_dhash(spark, d):
    return _px(spark, d).select("photo_id", "hash")


def px_chroma(spark, d):
    return _px(spark, d).select("photo_id", F.posexplode("signature").alias("i", "v"))


NAMES = (
    "score_photos", "reject_counts", "selection_sizes", "rank_photos", "top_n_per_session", "embedding_shortlist", "hash_popcount_degenerate",
    "pair_distances", "embedding_pairs", "near_duplicate_pairs", "pair_similarity", "content_scores", "content_baseline", "exif_epoch_ms",
    "file_name_repair", "duplicate_groups", "group_alternates", "diverse_top_k", "best_photos", "steering_state", "mean_embedding",
    "taste_direction", "taste_biases", "nearest_affinity", "steered_selection", "pick_novelty", "pick_reasons", "budgeted_originals",
    "upload_chunks", "session_summary", "steered_with_memory", "preference_upsert", "remembered_counts", "px_luma_stats", "px_focus_noise", "px_colorfulness", "px_dhash", "px_chroma",
)


def queries() -> dict:
    from . import intake_queries

    return {n: globals()[n] for n in NAMES} | intake_queries.queries()
