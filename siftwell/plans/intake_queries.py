"""Registered queries of intake, stored state, remembered taste and the two-pass selection."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cluster, intake, pixel_arrays, rank, select, state, steer, store
from ..sources import images
from ..sources import photos as src
from .queries import BIAS, QUERY, W, _preferences, ranked

KEYS = ["session_id", "photo_id"]


def _batch(spark, d) -> DataFrame:
    """All inputs with metrics where they could be measured: every ninth photo could not."""
    p = cluster.materialise(src.derived_photos(spark, d))
    inputs = p.select(*KEYS, "upload_idx", "size")
    return intake.with_metrics(inputs, p.where("photo_id % 9 <> 0").drop("upload_idx", "size"))


def analysis_split(spark, d):
    analysed, other = intake.split(_batch(spark, d))
    rows = [x.select(*KEYS, "upload_idx", F.lit(k).alias("part"), S.half_up(F.col("brightness")).cast("long").alias("brightness")) for x, k in ((analysed, "analysed"), (other, "unanalysed"))]
    return rows[0].unionByName(rows[1])


def embedding_overlay(spark, d):
    photos = src.derived_photos(spark, d)
    done = photos.where("photo_id % 4 <> 0").select(*KEYS, "embedding", F.when(F.col("embedding").isNull(), "decode failed").alias("error"))
    return intake.with_embeddings(photos, done).select(*KEYS, F.size(F.coalesce("embedding", F.array())).alias("dims"), "embed_error")


def shown_sources(spark, d):
    photos = src.derived_photos(spark, d)
    stored = lambda n, tag: photos.where(f"photo_id % {n} = 0").select(*KEYS, F.concat(F.lit(tag), F.col("photo_id").cast("string")).alias("source"))
    return intake.with_sources(photos.select(*KEYS), stored(6, "original "), stored(4, "preview ")).where("source is not null")


def merged_originals(spark, d):
    photos = src.derived_photos(spark, d)
    return intake.merged(photos.where("photo_id % 4 = 0").select(*KEYS, "size"), photos.where("photo_id % 6 = 0").select(*KEYS, (F.col("size") * 2).alias("size")), KEYS)


def zipped_originals(spark, d):
    lists = src.derived_photos(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("upload_idx", "photo_id", "size"))).alias("x"))
    lists = lists.select("session_id", F.transform("x", lambda e: S.original_key(F.col("session_id"), e["photo_id"])).alias("keys"), F.transform("x", lambda e: e["size"]).alias("sizes"))
    return intake.zipped(lists, "keys", "sizes", ("key", "size"))


def ranked_without_collapsed(spark, d):
    r = ranked(spark, d)
    return intake.uncollapsed(r, cluster.leader_groups(r, QUERY)).select(*KEYS, "rank")


def _kept(spark, d):
    """(analysed and ranked, unanalysed, selected, kept ids) of a batch; ranked and grouped once."""
    analysed, other = intake.split(_batch(spark, d))
    r = cluster.materialise(rank.rank(rank.score(analysed, QUERY)))
    groups = cluster.materialise(cluster.leader_groups(r, QUERY))
    picks = cluster.materialise(select.best_of(r, groups, W, BIAS, QUERY))
    return r, other, picks, intake.kept(intake.uncollapsed(r, groups), picks, other)


def kept_photos(spark, d):
    return _kept(spark, d)[3]


def kept_rows(spark, d):
    """What is stored of a batch: the photos that can still appear, measured or not."""
    r, _, _, ids = _kept(spark, d)
    return intake.rows_of(src.derived_photos(spark, d), ids).join(r.select(*KEYS, F.lit(True).alias("measured")), KEYS, "left").select(*KEYS, "upload_idx", "size", F.coalesce("measured", F.lit(False)).alias("measured"))


def kept_scores(spark, d):
    """The ranked photos that can still appear; the others' scores are not stored."""
    r, _, _, ids = _kept(spark, d)
    return intake.rows_of(r, ids).select(*KEYS, "rank", F.round("score", 6).alias("score"), F.col("embedding").isNotNull().alias("has_vector"))


def selected_scores(spark, d):
    """The scored rows of a selection."""
    r, _, picks, _ = _kept(spark, d)
    return intake.rows_of(r, picks).select(*KEYS, "rank", F.round("score", 6).alias("score"))


def embedding_files(spark, d):
    """The shortlist's files, where they are at hand: every photo with a capture time has one here."""
    files = src.derived_photos(spark, d).where("taken_at_ms is not null").select(*KEYS, F.concat(F.lit("file-"), F.col("photo_id").cast("string")).alias("file"))
    return intake.files_to_embed(rank.shortlist(ranked(spark, d)).select(*KEYS, "place"), files)


def selection_top_up(spark, d):
    batch = _batch(spark, d)
    analysed, other = intake.split(batch)
    totals = batch.groupBy("session_id").agg(F.count("*").alias("total"))
    return state.top_up(select.best_photos(analysed, W, BIAS, QUERY), other.select(*KEYS, "upload_idx"), totals)


def review_pool(spark, d):
    r = ranked(spark, d)
    return steer.review_pool(r, cluster.leader_groups(r, QUERY)).select(*KEYS)


def review_pool_of_failures(spark, d):
    r = ranked(spark, d).withColumn("rejected_for", F.when(F.col("session_id") % 2 == 0, "all fail").otherwise(F.col("rejected_for")))
    return steer.review_pool(r, cluster.leader_groups(r, QUERY)).select(*KEYS)


def review_summary(spark, d):
    analysed, other = intake.split(_batch(spark, d))
    r = rank.rank(rank.score(analysed, QUERY))
    return state.session_summary(r, cluster.leader_groups(r, QUERY), other, analysed.where("session_id % 2 = 0 and photo_id % 6 = 0"))


def two_pass_selection(spark, d):
    photos = src.derived_photos(spark, d)
    vectors = photos.select(*KEYS, "embedding")
    embedder = lambda shortlist: shortlist.select(*KEYS).join(vectors, KEYS).withColumn("error", F.when(F.col("embedding").isNull(), "no vector"))
    return intake.two_pass_selection(photos.drop("embedding"), embedder, W, BIAS, QUERY).select(*KEYS, "pick")


def remembered_exemplars(spark, d):
    return steer.remembered_for(3, _preferences(spark, d)).select("session_id", "place", "action", F.round(F.col("embedding")[0], 5).alias("x"))


def remembered_steering(spark, d):
    """Every photo's affinity to what other sessions liked and rejected."""
    photos = src.derived_photos(spark, d)
    others = cluster.materialise(steer.remembered_by(photos, _preferences(spark, d)))
    for action, into in (("like", "remembers_yes"), ("reject", "remembers_no")):
        photos = steer.nearest_affinity(photos, steer.references_of(others, action), into)
    return photos.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("remembers_yes", "remembers_no")])


def exemplar_order(spark, d):
    x = state.exemplars(_preferences(spark, d), "liked")
    return x.select("session_id", F.col("place.age").alias("age"), F.col("place.i").alias("i"), F.round(F.col("embedding")[0], 5).alias("x"))


def unit_vectors(spark, d):
    v = src.derived_photos(spark, d).where("embedding is not null").select("photo_id", S.unit_or_zero(F.when(F.col("photo_id") % 5 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))).alias("v"))
    return v.select("photo_id", F.posexplode("v").alias("i", "x")).select("photo_id", "i", F.round("x", 5).alias("x"))


def decoded_head(spark, d):
    """Content scores by weights as they are shipped: base64 of 32-bit floats."""
    shipped = base64.b64encode(np.array(W, "<f4").tobytes()).decode()
    return src.derived_photos(spark, d).where("embedding is not null").select("photo_id", F.round(S.content_score(F.col("embedding"), S.decode_weights(shipped), BIAS), 6).alias("score"))


def safe_ids(spark, d):
    return src.read(spark, d, "part").select("p_partkey", S.safe_id(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("p_"), F.col("p_partkey").cast("string"))).otherwise("")).alias("safe"))


def upload_statuses(spark, d):
    k = F.col("event_id")
    session = F.when(k % 7 == 0, "").when(k % 7 == 1, "no good/").otherwise(F.concat(F.lit("s"), (k % 7).cast("string")))
    return src.read(spark, d, "events").select("event_id", S.upload_status(session, k % 3, k % 2 == 0, k % 5 != 0).alias("status"))


def file_defaults(spark, d):
    p = src.read(spark, d, "part")
    blank = lambda c: F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 != 1, F.col(c))
    return p.select("p_partkey", S.default_name(blank("p_name"), F.col("p_partkey")).alias("name"), S.default_type(blank("p_type")).alias("type"))


def fitted_sizes(spark, d):
    return src.derived_photos(spark, d).select("photo_id", S.fit_within(F.col("photo_id") * 37 % 4000 + 1, F.col("photo_id") * 91 % 3000 + 1, 512).alias("s")).select("photo_id", "s.width", "s.height")


def progress_percent(spark, d):
    return src.derived_photos(spark, d).select("photo_id", S.percent_complete(F.col("photo_id") * 7 % 200, F.col("photo_id") % 250).cast("long").alias("percent"))


def _sessions(spark, d) -> DataFrame:
    x = src.derived_photos(spark, d).groupBy((F.col("photo_id") % 16).alias("session_id")).agg(F.max("photo_id").alias("created_at"), F.count("*").alias("n"))
    none = F.array().cast("array<bigint>")
    return x.select("session_id", "created_at", F.lit(False).alias("finalized"), none.alias("liked"), none.alias("rejected"), F.array("n").alias("selected"))


def _store(spark) -> store.Store:
    return store.Store(spark, cluster.shared_path(spark, "store"))


def session_upsert(spark, d):
    """Written, replaced in part, finalised, dropped in part, steered, and read back; each change writes the buckets it touches."""
    s = _store(spark)
    key = lambda k: spark.createDataFrame([(k,)], "session_id long")
    s.write("sessions", _sessions(spark, d))
    s.upsert("sessions", s.session(3).withColumn("created_at", F.lit(7).cast("long")))
    s.update("sessions", key(5), lambda old: store.finalised(old, 5))
    s.update("sessions", key(6), lambda old: store.without(old, 6))
    changes = spark.createDataFrame([(4, [1, 2], [3], [9]), (99, [1], [], [])], "session_id long, liked array<long>, rejected array<long>, selected array<long>")
    s.update("sessions", changes.select("session_id"), lambda old: store.steered(old, changes))
    size = lambda c: F.size(c).alias(c)
    return s.read("sessions").join(s.session_ids(), "session_id").select("session_id", "created_at", "finalized", size("liked"), size("rejected"), F.element_at("selected", 1).alias("first_selected"))


def session_keep_newest(spark, d):
    s = _store(spark)
    s.write("sessions", _sessions(spark, d))
    newest = s.read("sessions").orderBy(F.col("created_at").desc(), "session_id").first()["session_id"]
    s.write("sessions", store.only(s.read("sessions"), newest))
    return s.read("sessions").select("session_id", "created_at")


def session_append(spark, d):
    files = src.derived_photos(spark, d).select("session_id", "upload_idx", F.when(F.col("photo_id") % 3 > 0, F.concat(F.lit("n"), F.col("photo_id").cast("string"))).otherwise("").alias("name"), F.lit(None).cast("string").alias("type"), "size")
    s = _store(spark)
    s.write("photos", store.appended(s.read("photos"), files.where("upload_idx < 100")))
    s.write("photos", store.appended(s.read("photos"), files.where("upload_idx >= 100")))
    return s.read("photos")


def stored_originals(spark, d):
    """Originals within the budget replace all others; then one session's are read."""
    s, r = _store(spark), ranked(spark, d).withColumn("pick", F.col("rank"))
    s.write("originals", r.where("photo_id % 3 = 0").select(S.original_key(F.col("session_id"), F.col("photo_id")).alias("key"), F.lit(1).cast("long").alias("size")))
    wanted = state.budgeted(r, F.lit(5_000_000)).join(r.select(*KEYS, "size"), KEYS)
    s.write("originals", store.replaced_originals(s.read("originals"), wanted.select(S.original_key(F.col("session_id"), F.col("photo_id")).alias("key"), F.col("size").cast("long").alias("size"))))
    return store.originals_by_session(s.read("originals"))


def preference_store(spark, d):
    """Preferences in the store: written, a batch put in, all forgotten, a batch remembered anew; counted after each step."""
    s, own, steps = _store(spark), cluster.materialise(_preferences(spark, d)), []

    def counted(step):
        steps.append(state.remembered_counts(s.read("preferences")).select(F.lit(step).alias("step"), "liked", "rejected", "batches"))

    new = own.where("session_id = 3").withColumn("updated_at", F.lit(5000).cast("long"))
    s.write("preferences", state.upsert_preferences(s.read("preferences"), own))
    counted(1)
    s.write("preferences", state.upsert_preferences(s.read("preferences"), new))
    counted(2)
    s.clear("preferences")
    counted(3)
    s.write("preferences", state.upsert_preferences(s.read("preferences"), new))
    counted(4)
    return steps[0].unionByName(steps[1]).unionByName(steps[2]).unionByName(steps[3])


def photo_lookups(spark, d):
    """Requests for stored photos by key, answered: every photo's own, and as many for photos and sessions that are not there."""
    photos = src.derived_photos(spark, d)
    stored = photos.where("taken_at_ms is not null").select("session_id", F.col("photo_id").cast("string").alias("id"), F.concat(F.lit("n"), F.col("photo_id").cast("string")).alias("name"), F.lit("image/jpeg").alias("type"), "size")
    asked = photos.select(F.when(F.col("photo_id") % 10 != 3, F.col("session_id") + F.when(F.col("photo_id") % 10 == 4, 1000).otherwise(0)).alias("session_id"), F.col("photo_id").cast("string").alias("id"))
    return store.looked_up(asked, stored)


def session_lookups(spark, d):
    """Requests for sessions: one for each user of the events; sessions are those of the photos."""
    photos = src.derived_photos(spark, d)
    sessions = photos.groupBy("session_id").agg((F.count("*") % 2 == 0).alias("finalized"))
    asked = src.read(spark, d, "events").select(F.when(F.col("user_id") % 50 > 0, F.col("user_id") % 50 - 1).alias("session_id")).distinct()
    return store.session_answers(asked, sessions, photos)


def px_metrics(spark, d):
    """All metrics at once, photo by photo, as a score."""
    m = pixel_arrays.measure(images.generated_images(spark, src.read(spark, d, "embeddings").select("vec_id")))
    x = m.withColumn("session_id", F.lit(0)).withColumn("size", F.lit(0)).withColumn("upload_idx", F.col("photo_id"))
    return rank.score(x, QUERY).select("photo_id", F.round("score", 5).alias("score"), "rejected_for", F.size("signature").alias("cells"), "error")


def _plane_means(planes: np.ndarray) -> np.ndarray:
    return np.rint(planes.reshape(3, -1).astype(np.float64) * 255).mean(1)


def model_inputs(spark, d):
    """Means of the planes that a model gets to see."""
    drawn = images.generated_images(spark, src.read(spark, d, "embeddings").select("vec_id"))

    def run(batches):
        for batch in batches:
            means = [_plane_means(pixel_arrays.model_input(pixel_arrays.pixels_of(w, h, x))) for w, h, x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([float(m[i]) for m in means], pa.float64()) for i in range(3)]], ["photo_id", "r", "g", "b"])

    return drawn.mapInArrow(run, "photo_id long, r double, g double, b double").select("photo_id", *[F.round(c, 9).alias(c) for c in "rgb"])


NAMES = (
    "analysis_split", "embedding_overlay", "shown_sources", "merged_originals", "zipped_originals", "ranked_without_collapsed", "kept_photos", "selection_top_up",
    "review_pool", "review_pool_of_failures", "review_summary", "two_pass_selection", "remembered_exemplars", "remembered_steering", "exemplar_order", "unit_vectors", "decoded_head",
    "safe_ids", "upload_statuses", "file_defaults", "fitted_sizes", "progress_percent", "session_upsert", "session_keep_newest", "session_append", "stored_originals", "px_metrics", "kept_rows", "kept_scores", "selected_scores", "embedding_files", "preference_store", "photo_lookups", "session_lookups", "model_inputs",
)


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}
