"""Predicates and similarities of two photos: as Columns over prefixed column sets, and as arrays over blocks of photos."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .scalars import color_distance, degenerate, dot, hamming, num, remapped

SIDE = ("photo_id", "rank", "hash", "color_signature", "taken_at_ms", "embedding")


def look_alike(a: str = "a", b: str = "b", p: Params = DEFAULT) -> Column:
    """Whether two photos show the same by hash, colour and time. Cheap tests come first."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    bits, color = hamming(x("hash"), y("hash")), color_distance(x("color_signature"), y("color_signature"))
    structured = ~degenerate(x("hash"), p) & ~degenerate(y("hash"), p)
    return (
        F.when(bits > p.duplicate_loose, False)
        .when(structured & (bits <= p.duplicate_strict) & (color <= p.color_tight), True)
        .when(x("taken_at_ms").isNull() | y("taken_at_ms").isNull(), False)
        .when(F.abs(x("taken_at_ms") - y("taken_at_ms")) > p.burst_window_ms, False)
        .otherwise(color <= p.color_loose)
    )


def near_duplicate(a: str = "a", b: str = "b", p: Params = DEFAULT) -> Column:
    """Whether two photos show the same: by embeddings if both have one, else hash, colour and time."""
    x, y = F.col(f"{a}.embedding"), F.col(f"{b}.embedding")
    return F.when(x.isNotNull() & y.isNotNull(), dot(x, y) >= p.same_subject).otherwise(look_alike(a, b, p))


def similarity(a: str = "a", b: str = "b", p: Params = DEFAULT) -> Column:
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    near = lambda d, spread: num(1) - F.least(num(1), d / num(spread))
    time = F.coalesce(near(F.abs(x("taken_at_ms") - y("taken_at_ms")), p.time_spread_ms), num(0))
    cheap = num(0.5) * near(color_distance(x("color_signature"), y("color_signature")), p.color_spread) + num(0.3) * near(hamming(x("hash"), y("hash")), p.hash_bits / 2) + num(0.2) * time
    return F.when(x("embedding").isNotNull() & y("embedding").isNotNull(), remapped(dot(x("embedding"), y("embedding")), p)).otherwise(cheap)


def session_pairs(ranked: DataFrame, near_only: bool = False, p: Params = DEFAULT) -> DataFrame:
    """Pairs (a before b in rank) of a session, as structs a and b; with near_only those that are near-duplicates."""
    side = F.struct(*[c for c in SIDE])
    a, b = ranked.select("session_id", side.alias("a")), ranked.select("session_id", side.alias("b"))
    pairs = a.join(b, "session_id").where("a.rank < b.rank")
    return pairs.where(near_duplicate(p=p)) if near_only else pairs


def vectors(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the vectors, padded with zeros, and the length of each; -1 where there is none."""
    dims = np.array([-1 if v is None else len(v) for v in rows], int)
    matrix = np.zeros((len(rows), max([0, *dims])))
    for i, v in enumerate(rows):
        if v is not None:
            matrix[i, : len(v)] = v
    return matrix, dims


def features(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """What similarities are counted from, as arrays: unknown hashes, colours, times and vectors are marked as such."""
    hashed = np.array([h is not None and len(h) == 64 for h in pdf["hash"]], bool)
    words = np.array([[int(h[i : i + 16], 16) for i in range(0, 64, 16)] if k else [0] * 4 for h, k in zip(pdf["hash"], hashed, strict=True)], np.uint64).reshape(-1, 4)
    colors, sizes = vectors(pdf["color_signature"])
    matrix, dims = vectors(pdf["embedding"])
    return {"hash": words, "hashed": hashed, "colors": colors, "sizes": sizes, "times": pdf["taken_at_ms"].astype(float).to_numpy(), "vectors": matrix, "dims": dims}


def similarities(one: dict[str, np.ndarray], i: int, others: dict[str, np.ndarray], p: Params = DEFAULT) -> np.ndarray:
    """``similarity`` of photo i of one set to every photo of others."""

    def fitted(x: np.ndarray, width: int) -> np.ndarray:
        return np.pad(x, (0, max(0, width - len(x))))[:width]

    near = lambda d, spread: 1 - np.minimum(1, d / spread)
    size = one["sizes"][i]
    alike = (others["sizes"] == size) & (size > 0)
    color = np.where(alike, np.abs(others["colors"] - fitted(one["colors"][i], others["colors"].shape[1])).sum(1) / max(size, 1), 255.0)
    bits = np.bitwise_count(others["hash"] ^ one["hash"][i]).sum(1, dtype=np.int64).astype(float)
    bits[~(others["hashed"] & one["hashed"][i])] = float((1 << 53) - 1)
    gap = np.abs(others["times"] - one["times"][i])
    out = 0.5 * near(color, p.color_spread) + 0.3 * near(bits, p.hash_bits / 2) + 0.2 * np.where(np.isnan(gap), 0.0, near(np.nan_to_num(gap), p.time_spread_ms))
    if one["dims"][i] >= 0:
        # Vectors of another length are unlike: a cosine of 0.
        cos = np.where(others["dims"] == one["dims"][i], others["vectors"] @ fitted(one["vectors"][i], others["vectors"].shape[1]), 0.0)
        out = np.where(others["dims"] >= 0, np.clip((cos - p.cosine_floor) / p.cosine_range, 0, 1), out)
    return out
