"""Operators of large sessions give what they give for small ones, whatever the sizes of parts and blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import pairs
from siftwell.operators import quantiles, select, steer

SCHEMA = "session_id long, photo_id long, rank int, hash string, color_signature array<int>, taken_at_ms long, embedding array<double>, value double, discount double, k int, seed boolean"


def contenders(spark, seed, sizes, vector=True):
    r, rows = random.Random(seed), []
    for s, (n, k, seeds) in sizes.items():
        for i in range(n):
            bits = int("a5" * 32, 16) ^ (r.getrandbits(256) if r.random() < 0.5 else 1 << r.randrange(256))
            v = [r.gauss(0, 1) for _ in range(4)]
            v = [x / sum(y * y for y in v) ** 0.5 for x in v]
            rows.append((
                s, 1000 * s + (i * 7) % n, i + 1, r.choice((None, "0f", f"{bits:064x}", f"{bits:064x}", f"{bits:064x}")),
                r.choice((None, [], [5, 9], [r.randrange(90) for _ in range(8)], [r.randrange(90) for _ in range(8)])), r.choice((None, r.randrange(3_000_000))),
                r.choice((None, [], v[:2], v, v, v)) if vector else None, round(r.random() * 0.3, 2), r.choice((1.0, 0.5)), k, i in seeds,
            ))
    return spark.createDataFrame(rows, SCHEMA)


def picked(pool, seeds=True, **how):
    got = select.diverse_top_k(pool, F.col("k"), F.col("value"), F.col("discount"), seeds=pool if seeds else None, **how)
    return {(x.session_id, x.pick): x.photo_id for x in got.collect()}


@pytest.mark.parametrize(("vector", "part", "ahead"), [(True, 9, 8), (False, 20, 400)])
def test_picks_do_not_depend_on_parts(spark, vector, part, ahead):
    sizes = {1: (150, 20, ()), 2: (30, 60, (3, 8)), 3: (3, 2, ()), 4: (80, 12, (0, 5, 9, 30)), 5: (20, 2, (1, 2, 3)), 6: (1, 5, ())}
    pool = contenders(spark, 4, sizes, vector)
    want = picked(pool, rows_per_task=10**6)
    assert sum(1 for s, _ in want if s == 2) == 30 and sum(1 for s, _ in want if s == 1) == 20
    assert picked(pool, rows_per_task=part, ahead=ahead) == want


def test_picks_equal_a_plain_greedy(spark):
    """Against similarities as Columns, pair by pair."""
    pool = contenders(spark, 9, {1: (60, 8, ())})
    rows = {x.photo_id: x for x in pool.collect()}
    a, b = (pool.select("session_id", F.struct(*pairs.SIDE).alias(c)) for c in "ab")
    sims = {(x.i, x.j): x.s for x in a.join(b, "session_id").select(F.col("a.photo_id").alias("i"), F.col("b.photo_id").alias("j"), pairs.similarity().alias("s")).collect()}
    left, chosen = dict(rows), []
    while len(chosen) < 8:
        gain = lambda x: x.value - 0.15 * x.discount * max([0.0, *(sims[x.photo_id, c] for c in chosen)])
        best = max(left.values(), key=lambda x: (gain(x), -x["rank"]))
        chosen.append(left.pop(best.photo_id).photo_id)
    assert [v for _, v in sorted(picked(pool).items())] == chosen == [v for _, v in sorted(picked(pool, rows_per_task=20, ahead=2).items())]


@pytest.mark.parametrize(("rows_per_task", "steps"), [(1, 4), (5, 1024), (10**6, 4)])
def test_order_statistics(spark, rows_per_task, steps):
    """Odd and even counts, ties, one value only, skewed values, nulls."""
    r = random.Random(2)
    sets = {1: [r.random() for _ in range(101)], 2: [r.choice((1.0, 1.0, 2.0)) for _ in range(60)], 3: [7.0] * 40, 4: [10.0 ** r.randint(-9, 9) for _ in range(64)], 5: [3.0], 6: [-1.0, 1e-300, None, 1.0]}
    df = spark.createDataFrame([(s, x) for s, v in sets.items() for x in v] + [(7, None)], "session_id long, x double").repartition(3)
    n = F.col("n")
    got = quantiles.order_statistics(df, {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "third": F.least(n - 1, F.floor(n * 0.75))}, rows_per_task, steps).collect()
    want = {}
    for s, v in sets.items():
        v = sorted(x for x in v if x is not None)
        want[s] = (len(v), v[(len(v) - 1) // 2], v[len(v) // 2], v[min(len(v) - 1, int(len(v) * 0.75))])
    assert {x.session_id: (x.n, x.low, x.high, x.third) for x in got} == want
    assert quantiles.order_statistics(df.limit(0), {"low": n * 0}, rows_per_task, steps).count() == 0


def test_affinity_in_blocks(spark):
    r = np.random.default_rng(1)
    photos = [(s, i, r.normal(size=3).tolist() if i % 5 else None) for s in (1, 2, 3) for i in range(30)] + [(1, 99, [0.5, 0.5]), (1, 98, [])]
    refs = [(s, r.normal(size=3).tolist()) for s in (1, 2) for _ in range(25)] * 2 + [(1, None), (2, [1.0]), (9, [1.0, 0.0, 0.0])]
    df, against = spark.createDataFrame(photos, "session_id long, photo_id long, embedding array<double>"), spark.createDataFrame(refs, "session_id long, reference array<double>")
    want = {}
    for s, i, v in photos:
        cosines = [float(np.dot(v, x)) if len(x) == len(v) else 0.0 for t, x in refs if v is not None and x is not None and t == s]
        want[s, i] = max([0.0, *(min(1.0, max(0.0, (c - 0.19) / 0.81)) for c in cosines)])
    for block in (4, 1000):
        got = {(x.session_id, x.photo_id): x.near for x in steer.nearest_affinity(df, against, "near", block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert steer.nearest_affinity(df, against.limit(0), "near").where("near <> 0").count() == 0


def test_unlike_hashes_and_colours_do_not_stop_a_selection(spark):
    pool = contenders(spark, 1, {1: (12, 5, ())}).withColumn("hash", F.lit(None).cast("string"))
    assert len(picked(pool)) == 5


def test_texts_are_hashed_before_they_are_joined(spark):
    from siftwell.sources import photos as src

    plan = src.derived_photos(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and "sha2" not in plan[: plan.index("Join")]


def test_a_kept_batch_is_grouped_once(spark, monkeypatch):
    from siftwell.operators import cluster
    from siftwell.plans import intake_queries

    calls, real = [], cluster.near_edges
    monkeypatch.setattr(cluster, "near_edges", lambda *a: calls.append(a) or real(*a))
    assert intake_queries.kept_photos(spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1
