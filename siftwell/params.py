"""Thresholds of the curation engine. The defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # how many to select
    selection_ratio: float = 0.1
    min_selection: int = 5
    max_selection: int = 50
    # focus
    focus_sharp: float = 0.12
    focus_blurred: float = 0.01
    sharpness_floor: float = 2.0
    sharpness_ceiling: float = 40.0
    focus_reject: float = 0.3
    noise_clean: float = 1.2
    noise_heavy: float = 3.5
    noise_max_penalty: float = 0.6
    # clipping
    clip_tolerance: float = 0.02
    clip_worst: float = 0.15
    clip_reject: float = 0.25
    # weights of the score
    w_focus: float = 0.5
    w_exposure: float = 0.3
    w_tone: float = 0.1
    w_color: float = 0.1
    # near-duplicates
    duplicate_strict: int = 10
    duplicate_loose: int = 48
    color_tight: float = 4.0
    color_loose: float = 10.0
    burst_window_ms: int = 30_000
    same_subject: float = 0.9
    # similarity and diversity
    diversity_weight: float = 0.15
    color_spread: float = 40.0
    hash_bits: int = 256
    time_spread_ms: int = 1_200_000
    cosine_floor: float = 0.19
    cosine_range: float = 0.81
    # steering
    reject_weight: float = 0.5
    remembered_reject_weight: float = 0.2
    remembered_like_relief: float = 0.3
    like_relief: float = 0.5
    taste_min_labels: int = 3
    taste_confident: int = 10
    taste_scale: float = 0.45
    taste_weight: float = 0.12
    clearly_to_taste: float = 0.5
    # content prior
    content_weight: float = 0.12
    content_spread: float = 1.64
    personal_displaces: float = 0.5
    baseline_min: int = 4
    baseline_quantile: float = 0.75
    # reasons
    novel_enough: float = 0.45
    clearly_remembered: float = 0.55
    # state
    shortlist_least: int = 16
    max_batches: int = 10
    max_per_batch: int = 20
    originals_budget: int = 150 * 1024 * 1024
    upload_chunk: int = 5


DEFAULT = Params()
