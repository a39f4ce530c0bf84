"""Content baseline, greedy diverse top-k, best photos, steered selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.pairs import features, similarities
from ..params import DEFAULT, Params
from ..sources.tables import materialise
from .cluster import leader_groups
from .quantiles import order_statistics
from .rank import rank, score


def content_baseline(scored: DataFrame, weights: list[float], bias: float, p: Params = DEFAULT, rows_per_task: int = 100_000) -> DataFrame:
    """(session_id, median, standout) of content scores; sessions with fewer than 4 scores have none."""
    n = F.col("n")
    places = {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "standout": F.least(n - 1, F.floor(n * S.num(p.baseline_quantile)))}
    found = order_statistics(scored.select("session_id", S.content_score(F.col("embedding"), weights, bias).alias("x")), places, rows_per_task)
    return found.where(n >= p.baseline_min).select("session_id", ((F.col("low") + F.col("high")) / 2).alias("median"), "standout")


CONTENDER = ("session_id", "photo_id", "rank", "hash", "color_signature", "taken_at_ms", "embedding")
PICKS = "session_id long, photo_id long, pick int"


def contenders(pool: DataFrame, k: Column, value: Column, discount: Column | None, seeds: bool, p: Params) -> DataFrame:
    """The photos that can be picked, with k, value and discount: all but those more than the whole penalty below the session's k-th best."""
    rows = pool.withColumn("k", k.cast("int")).withColumn("value", value).withColumn("discount", discount if discount is not None else S.num(1)).withColumn("seed", F.col("seed") if seeds else F.lit(False))
    rows = rows.select(*CONTENDER, "k", "value", "discount", "seed")
    most = max(p.max_selection, p.min_selection)
    best = Window.partitionBy("session_id").orderBy(F.col("value").desc(), "rank")
    top = rows.where("not seed").select("session_id", "rank", "value", "k").withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    floor = top.where("place <= k").groupBy("session_id").agg(F.min("value").alias("least"), F.max("k").alias("asked"), F.count("*").alias("n"))
    # Where more than the most are asked for, the k-th best is not among these, and nobody is left out.
    floor = floor.where((F.col("asked") <= most) | (F.col("n") < most)).select("session_id", (F.col("least") - p.diversity_weight).alias("least"))
    return rows.join(floor, "session_id", "left").where("seed or value >= coalesce(least, value)").drop("least")


def _greedy(pdf: pd.DataFrame, penalty: np.ndarray, wanted: int, p: Params, bound: tuple[float, int] | None = None) -> list[int]:
    """Row numbers of up to ``wanted`` greedy picks; rows are in rank order. It ends where a photo outside, at ``bound`` (gain, rank) at best, could come first."""
    arrays, value, discount, ranks = features(pdf), pdf["value"].to_numpy(), pdf["discount"].to_numpy(), pdf["rank"].to_numpy()
    free, picks = np.ones(len(pdf), bool), []
    while len(picks) < wanted and free.any():
        gain = np.where(free, value - p.diversity_weight * penalty * discount, -np.inf)
        i = int(np.argmax(gain))
        if bound is not None and (-gain[i], ranks[i]) > (-bound[0], bound[1]):
            break
        picks.append(i)
        free[i] = False
        penalty = np.maximum(penalty, similarities(arrays, i, arrays, p))
    return picks


def _in_one_task(rows: DataFrame, p: Params) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seed", "rank"], ascending=[False, True]).reset_index(drop=True)
        n_seeds, arrays, penalty = int(pdf["seed"].sum()), features(pdf), np.zeros(len(pdf))
        for i in range(n_seeds):
            penalty = np.maximum(penalty, similarities(arrays, i, arrays, p))
        rest = pdf.iloc[n_seeds:].reset_index(drop=True)
        picks = [*range(n_seeds), *(n_seeds + i for i in _greedy(rest, penalty[n_seeds:], int(pdf["k"].iloc[0]) - n_seeds, p))]
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "photo_id": pdf["photo_id"].to_numpy()[picks], "pick": np.arange(len(picks))})

    return rows.groupBy("session_id").applyInPandas(run, PICKS)


def _in_rounds(rows: DataFrame, p: Params, part_rows: int, ahead: int) -> DataFrame:
    """Picks of sessions that are spread over tasks. rows: a stored table of contenders.

    Gains only fall as picks are added, so a stale gain is an upper bound. In a round every task works out its photos' gains under the picks so far;
    the ``ahead`` best of the session come together and are picked one after another, as long as the best of them beats
    the next gain behind them. A round adds a pick at least.
    """
    seed_order = Window.partitionBy("session_id").orderBy("rank")
    sizes = rows.groupBy("session_id").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"), F.max("k").alias("wanted"), F.count("*").alias("n"))
    rest = materialise(rows.where("not seed").join(sizes.select("session_id", "parts"), "session_id").withColumn("part", F.pmod(F.xxhash64("photo_id"), "parts").cast("int")).drop("parts", "seed", "k"))
    shape = [c for c in CONTENDER if c not in ("rank",)]
    picks = materialise(rows.where("seed").withColumn("pick", F.row_number().over(seed_order) - 1).select(*shape, "pick"))
    state = rest.columns

    def gains(photos: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        arrays, own, penalty = features(photos), features(chosen), np.zeros(len(photos))
        for i in range(len(chosen)):
            penalty = np.maximum(penalty, similarities(own, i, arrays, p))
        fresh = ~photos["photo_id"].isin(chosen["photo_id"]).to_numpy()
        gain = photos["value"].to_numpy() - p.diversity_weight * penalty * photos["discount"].to_numpy()
        out = pd.DataFrame({"session_id": photos["session_id"], "photo_id": photos["photo_id"], "rank": photos["rank"], "penalty": penalty, "gain": gain})[fresh]
        best = np.lexsort((out["rank"], -out["gain"]))[: ahead + 1]
        return out.iloc[best]

    def advance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        behind = pdf[pdf["place"] > ahead]
        bound = (float(behind["gain"].iloc[0]), int(behind["rank"].iloc[0])) if len(behind) else None
        near = pdf[pdf["place"] <= ahead].sort_values("rank").reset_index(drop=True)
        have, wanted = int(pdf["have"].iloc[0]), int(pdf["wanted"].iloc[0])
        chosen = _greedy(near, near["penalty"].to_numpy().astype(float), wanted - have, p, bound)
        return pd.DataFrame({"session_id": near["session_id"].iloc[chosen], "photo_id": near["photo_id"].iloc[chosen], "pick": have + np.arange(len(chosen))})

    while True:
        have = picks.groupBy("session_id").agg(F.count("*").alias("have"))
        more = materialise(sizes.join(have, "session_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < least(wanted, n)"))
        if more.isEmpty():
            return picks.select("session_id", "photo_id", F.col("pick").cast("int").alias("pick"))
        live = rest.join(more.select("session_id"), "session_id", "left_semi")
        sent = picks.join(more.select("session_id", "parts"), "session_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        told = live.groupBy("session_id", "part").cogroup(sent.groupBy("session_id", "part")).applyInPandas(gains, "session_id long, photo_id long, rank int, penalty double, gain double")
        order = Window.partitionBy("session_id").orderBy(F.col("gain").desc(), "rank")
        front = materialise(told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ahead + 1))
        around = front.join(rest.drop("rank"), ["session_id", "photo_id"]).join(more.select("session_id", "have", "wanted"), "session_id")
        new = around.groupBy("session_id").applyInPandas(advance, PICKS)
        picks = materialise(picks.unionByName(new.join(rest.select(*[c for c in shape if c in state]), ["session_id", "photo_id"]).select(*shape, F.col("pick").cast(picks.schema["pick"].dataType))))


def diverse_top_k(pool: DataFrame, k: Column, value: Column, discount: Column | None = None, seeds: DataFrame | None = None, p: Params = DEFAULT, rows_per_task: int = 20_000, ahead: int = 400) -> DataFrame:
    """(session_id, photo_id, pick): greedy picks of value - 0.15 * discount * (largest similarity to a pick).

    pool has the columns of a ranked photo; the first in rank wins a tie. Seeds (marked in the column seed where
    given) stand at the head and count towards k. A session with up to ``rows_per_task`` contenders is picked from in one task,
    a larger one in rounds over parts of that size.
    """
    rows = materialise(contenders(pool, k, value, discount, seeds is not None, p))
    sizes = rows.groupBy("session_id").agg((F.count("*") > rows_per_task).alias("large"))
    if sizes.where("large").isEmpty():
        return _in_one_task(rows, p)
    few = rows.join(sizes.where("not large").select("session_id"), "session_id", "left_semi")
    many = materialise(rows.join(sizes.where("large").select("session_id"), "session_id", "left_semi"))
    return _in_one_task(few, p).unionByName(_in_rounds(many, p, max(1, rows_per_task), ahead))


def best_photos(photos: DataFrame, weights: list[float], bias: float, p: Params = DEFAULT) -> DataFrame:
    """The best-photos query: collapse, bar, baseline, diverse picks; (session_id, photo_id, upload_idx, pick).

    The count is taken from all representatives. A session whose representatives all fail gets the
    best five of them.
    """
    ranked = materialise(rank(score(photos, p)))
    return best_of(ranked, leader_groups(ranked, p), weights, bias, p)


def best_of(ranked: DataFrame, groups: DataFrame, weights: list[float], bias: float, p: Params = DEFAULT) -> DataFrame:
    """best_photos of photos that are ranked and grouped already; ranked: a stored table."""
    reps = materialise(ranked.join(groups.where("rank_in_group = 0").select("session_id", "photo_id"), ["session_id", "photo_id"], "left_semi"))
    sizes = reps.groupBy("session_id").agg(S.selection_size(F.count("*"), p).alias("k"), F.max(F.col("rejected_for").isNull()).alias("any_good"))
    good = reps.where("rejected_for is null")
    pool = good.join(sizes.select("session_id", "k"), "session_id").join(content_baseline(good, weights, bias, p), "session_id", "left")
    value = F.col("score") + S.content_bias(S.content_score(F.col("embedding"), weights, bias), F.col("median"), S.num(0), p)
    picks = diverse_top_k(pool, F.col("k"), value, p=p)
    w = Window.partitionBy("session_id").orderBy("rank")
    bad = reps.join(sizes.where("not any_good"), "session_id").select("session_id", "photo_id", "k", "rank").withColumn("place", F.row_number().over(w)).where(F.col("place") <= p.min_selection)
    fallback = bad.where("place <= k").select("session_id", "photo_id", (F.col("place") - 1).cast("int").alias("pick"))
    return picks.unionByName(fallback).join(ranked.select("session_id", "photo_id", "upload_idx"), ["session_id", "photo_id"])
