"""Behaviour on hand-made photos."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import scalars as S
from siftwell.operators import cluster, rank, select, state, steer

BASE = dict(
    session_id=1, size=2_000_000, taken_at_ms=None, sharpness=540.0, center_sharpness=140.0, focus=0.25, noise_ratio=0.65, contrast=46.0, brightness=118.0,
    clipped_shadows=0.004, clipped_highlights=0.001, dynamic_range=180.0, colorfulness=40.0, hash="0f" * 32, color_signature=[80 + i % 5 for i in range(32)], embedding=None,
)
SCHEMA = (
    "session_id long, upload_idx int, photo_id long, size long, taken_at_ms long, sharpness double, center_sharpness double, focus double, noise_ratio double, contrast double, brightness double, "
    "clipped_shadows double, clipped_highlights double, dynamic_range double, colorfulness double, hash string, color_signature array<int>, embedding array<float>"
)


def photos(spark, *changes):
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    full = [BASE | dict(upload_idx=i, photo_id=i) | c for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)


def groups(spark, *changes):
    g = cluster.leader_groups(rank.rank(rank.score(photos(spark, *changes))))
    return {r.photo_id: r.leader_id for r in g.collect()}


def test_labels(spark):
    cases = [{}, dict(focus=0.002, sharpness=4.0), dict(clipped_highlights=0.34), dict(clipped_shadows=0.4), dict(focus=2.8, sharpness=6000.0, noise_ratio=2.9)]
    got = rank.score(photos(spark, *cases)).orderBy("photo_id").collect()
    assert [r.rejected_for for r in got] == [None, "out of focus", "blown highlights", "crushed shadows", None]
    assert got[4].score < got[0].score


@pytest.mark.parametrize("total, wanted", [(0, 0), (3, 3), (20, 5), (100, 10), (500, 50), (5000, 50)])
def test_selection_size(spark, total, wanted):
    assert spark.range(1).select(S.selection_size(F.lit(total))).first()[0] == wanted


def test_duplicates_need_structure_and_colour(spark):
    assert groups(spark, {}, {}) == {0: 0, 1: 0}
    assert groups(spark, {}, dict(color_signature=[10 + i % 3 for i in range(32)])) == {0: 0, 1: 1}
    assert groups(spark, {}, dict(hash="a5" * 32)) == {0: 0, 1: 1}


def test_degenerate_hash_needs_time(spark):
    flat = dict(hash="ff" * 32)
    assert groups(spark, flat, flat) == {0: 0, 1: 1}
    assert groups(spark, flat | dict(taken_at_ms=0), flat | dict(taken_at_ms=2000)) == {0: 0, 1: 0}
    assert groups(spark, flat | dict(taken_at_ms=0), flat | dict(taken_at_ms=3_600_000)) == {0: 0, 1: 1}


def test_larger_file_leads(spark):
    assert groups(spark, dict(size=400_000), dict(size=4_000_000)) == {0: 1, 1: 1}


def test_leader_rounds_equal_the_greedy_scan(spark):
    """A chain of neighbours: not transitive, so components would be wrong."""
    vec = lambda a: [float(__import__("math").cos(a)), float(__import__("math").sin(a))]
    got = groups(spark, *[dict(embedding=vec(0.3 * i), size=10_000 - i) for i in range(9)])
    leaders, want = [], {}
    for i in range(9):
        hit = next((x for x in leaders if __import__("math").cos(0.3 * (i - x)) >= 0.9), None)
        want[i] = i if hit is None else hit
        leaders += [i] if hit is None else []
    assert got == want


def test_all_rejected_is_not_empty(spark):
    bad = [dict(focus=0.001, sharpness=2.0, color_signature=[(11 * i) % 250] * 32) for i in range(6)]
    assert select.best_photos(photos(spark, *bad), [1.0], 0.0).count() == 5


def test_budget_skips_what_does_not_fit(spark):
    files = spark.createDataFrame([(1, i, s, i) for i, s in enumerate((60, 100, 30, 50))], "session_id long, photo_id long, size long, pick int")
    assert sorted(r.photo_id for r in state.budgeted(files, F.lit(100)).collect()) == [0, 2]


def test_toggle(spark):
    taps = [(1, 1, "like"), (1, 1, "like"), (1, 2, "like"), (1, 2, "reject"), (1, 3, "like")]
    df = spark.createDataFrame([(s, p, a, i, i) for i, (s, p, a) in enumerate(taps)], "session_id long, photo_id long, action string, ts long, event_id long")
    assert {(r.photo_id, r.action) for r in steer.steering_state(df).collect()} == {(2, "reject"), (3, "like")}


def test_steering_pins_and_drops(spark):
    vec = lambda i: [1.0, 0.0] if i < 6 else [0.0, 1.0]
    x = rank.rank(rank.score(photos(spark, *[dict(embedding=vec(i), color_signature=[(7 * i) % 250] * 32) for i in range(12)])))
    taps = spark.createDataFrame([(1, 7, "like"), (1, 0, "reject")], "session_id long, photo_id long, action string")
    got = [r.photo_id for r in steer.steered_selection(x, taps, [1.0], 0.0).orderBy("pick").collect()]
    assert got[0] == 7 and 0 not in got and len(got) == 5


def test_like_without_a_vector_relieves_nothing(spark):
    """A liked photo without a vector has no direction, so repeating what it shows costs as much as without it."""
    vec = lambda i: None if i == 11 else [1.0, 0.0] if i < 6 else [0.0, 1.0]
    x = rank.rank(rank.score(photos(spark, *[dict(embedding=vec(i), taken_at_ms=None, color_signature=[20 * i] * 32, focus=0.08 if 6 <= i < 11 else 1.0) for i in range(12)])))
    taps = spark.createDataFrame([(1, 11, "like")], "session_id long, photo_id long, action string")
    got = [r.photo_id for r in steer.steered_selection(x, taps, [1.0], 0.0).orderBy("pick").collect()]
    free = x.withColumn("seed", F.col("photo_id") == 11)
    full, half = ([r.photo_id for r in select.diverse_top_k(free, F.lit(5), F.col("score"), F.lit(w), seeds=x).orderBy("pick").collect()] for w in (1.0, 0.5))
    assert got[0] == 11 and got == full and got != half


def test_unknown_is_neutral(spark):
    x = spark.createDataFrame([(None, [1.0], 0.5)], "embedding array<double>, vector array<double>, confidence double")
    assert x.select(steer.taste_bias()).first()[0] == 0.0


def test_mean_follows_the_first_vector(spark):
    from siftwell.operators import steer

    rows = [(1, 3, [1.0]), (1, 1, [3.0, 4.0]), (1, 2, [5.0]), (2, 1, [0.0, 0.0])]
    got = dict(steer.mean_embedding(spark.createDataFrame(rows, "session_id long, photo_id long, embedding array<double>"), ["session_id"]).collect())
    assert got == {1: [0.6, 0.8], 2: None}


def test_store(spark, tmp_path):
    from siftwell.operators import store

    s = store.Store(spark, str(tmp_path / "store"))
    assert s.read("sessions").isEmpty() and s.session_ids().isEmpty()
    with pytest.raises(ValueError, match="unknown session"):
        store.finalised(s.read("sessions"), 1)
    files = spark.createDataFrame([(1, 0, "", None, 5), (1, 1, "x.png", "image/png", 6)], "session_id long, upload_idx int, name string, type string, size long")
    s.write("photos", store.appended(s.read("photos"), files))
    s.write("photos", store.appended(s.read("photos"), files))
    rows = s.read("photos").orderBy("position").collect()
    assert [r.position for r in rows] == [0, 1, 2, 3] and len({r.id for r in rows}) == 4
    assert rows[0].name == f"{rows[0].id}.jpg" and rows[0].type == "image/jpeg" and rows[3].id.startswith("p0003_")
    assert store.only(s.read("photos"), None).isEmpty()


def test_two_passes_need_two_vectors(spark):
    from pyspark.sql import functions as F

    from siftwell.operators import intake
    from siftwell.sources import photos

    p = photos.derived_photos(spark, "/root/testdata/sf0.001").drop("embedding")
    none = lambda x: x.select("session_id", "photo_id", F.lit(None).cast("array<double>").alias("embedding"), F.lit("no model").alias("error"))
    w, b = photos.content_head()
    assert intake.two_pass_selection(p, none, w, b).count() > 0
