"""Scalar functions as Column builders: everything stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def num(x: float) -> Column:
    return F.lit(float(x))


def half_up(x: Column) -> Column:
    """Rounds halves upwards, negative ones too."""
    return F.floor(x + num(0.5))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    # least and greatest skip nulls, so an unknown value is kept unknown here.
    return F.when(x.isNotNull(), F.greatest(num(lo), F.least(num(hi), x)))


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 below lo, 1 above hi, linear between; 0 if lo equals hi."""
    return num(0) if lo == hi else clamp((x - num(lo)) / num(hi - lo))


def _log_ramp(x: Column, lo: float, hi: float) -> Column:
    from math import log10

    return ramp(F.log10(F.greatest(x, num(1e-6))), log10(lo), log10(hi))


def focus_score(p: Params = DEFAULT) -> Column:
    sharp = F.least(_log_ramp(F.col("focus"), p.focus_blurred, p.focus_sharp), _log_ramp(F.col("sharpness"), p.sharpness_floor, p.sharpness_ceiling))
    return sharp * (num(1) - num(p.noise_max_penalty) * ramp(F.col("noise_ratio"), p.noise_clean, p.noise_heavy))


def exposure_score(p: Params = DEFAULT) -> Column:
    worst = F.greatest(F.col("clipped_highlights"), F.col("clipped_shadows"))
    clip = num(1) - ramp(worst, p.clip_tolerance, p.clip_worst)
    b = F.col("brightness")
    tent = F.when(b < 110, ramp(b, 35, 110)).when(b > 150, num(1) - ramp(b, 150, 235)).otherwise(num(1))
    return num(0.6) * clip + num(0.4) * tent


def tone_score() -> Column:
    return num(0.6) * ramp(F.col("dynamic_range"), 40, 170) + num(0.4) * ramp(F.col("contrast"), 12, 55)


def color_score() -> Column:
    return ramp(F.col("colorfulness"), 8, 55)


def reject_label(focus: Column, p: Params = DEFAULT) -> Column:
    """The first rule that fails, or null."""
    return (
        F.when(focus < p.focus_reject, "out of focus")
        .when(F.col("clipped_highlights") > p.clip_reject, "blown highlights")
        .when(F.col("clipped_shadows") > p.clip_reject, "crushed shadows")
    )


def selection_size(total: Column, p: Params = DEFAULT) -> Column:
    wanted = F.greatest(F.lit(p.min_selection), F.least(F.lit(p.max_selection), half_up(total * num(p.selection_ratio))))
    return F.when(total <= 0, F.lit(0)).otherwise(F.least(total, wanted)).cast("long")


def _word(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")


def hash_words(h: Column) -> Column:
    """The eight numbers of 32 bits that 64 hex digits hold."""
    return F.array(*[_word(h, i) for i in range(8)])


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings of 64 digits; other or unequal lengths are infinitely far."""
    bits = sum((F.bit_count(_word(a, i).bitwiseXOR(_word(b, i))) for i in range(1, 8)), F.bit_count(_word(a, 0).bitwiseXOR(_word(b, 0))))
    return F.when((F.length(a) == 64) & (F.length(b) == 64), bits.cast("long")).otherwise(F.lit((1 << 53) - 1))


def ones(h: Column) -> Column:
    bits = [F.bit_count(_word(h, i)) for i in range(8)]
    return sum(bits[1:], bits[0]).cast("long")


def degenerate(h: Column, p: Params = DEFAULT) -> Column:
    return (ones(h) < 0.1 * p.hash_bits) | (ones(h) > 0.9 * p.hash_bits)


def color_distance(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), num(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a)).otherwise(num(255))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; 0 for unequal lengths, null if a side is null."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), num(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) == F.size(b), total).otherwise(num(0))


def unit(v: Column) -> Column:
    """v at length 1; null for a zero vector."""
    norm = F.sqrt(F.aggregate(v, num(0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def unit_or_zero(v: Column) -> Column:
    """v at length 1; a zero vector stays as it is."""
    return F.coalesce(unit(v), F.transform(v, lambda x: x.cast("double")))


def remapped(cosine: Column, p: Params = DEFAULT) -> Column:
    return clamp((cosine - num(p.cosine_floor)) / num(p.cosine_range))


def content_score(embedding: Column, weights: list[float], bias: float) -> Column:
    """Linear head; null without an embedding or with one of another length."""
    return F.when(F.size(embedding) == len(weights), num(bias) + dot(embedding, F.array(*[num(w) for w in weights])))


def content_bias(score: Column, median: Column, damping: Column, p: Params = DEFAULT) -> Column:
    off = clamp((score - median) / num(p.content_spread / 2), -1, 1)
    return F.coalesce(num(p.content_weight) * (num(1) - damping) * off, num(0))


def exif_epoch_ms(text: Column, zone: Column) -> Column:
    """EXIF date (and zone, else UTC) -> epoch milliseconds; null if it is none. Blanks around both don't count; a zone counts as a whole or not at all."""
    text, zone = _trimmed(text), _trimmed(zone)
    pattern = r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}:\d{2}:\d{2})"
    offset = F.when(F.coalesce(zone, F.lit("")).rlike(r"^[+-]\d{2}:\d{2}$"), zone).otherwise("+00:00")
    part = lambda i: F.regexp_extract(text, pattern, i)
    whole = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), offset)
    return F.when(text.rlike(pattern), F.unix_millis(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ssXXX"))))


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def sane_file_name(name: Column, mime: Column) -> Column:
    """The name with an extension, taken from the type where it has none."""
    kind = F.regexp_replace(F.element_at(F.split(mime, "/"), -1), "^jpeg$", "jpg")
    return F.when(name.rlike(r"(?i)\.[a-z0-9]{3,4}$"), name).otherwise(F.concat(name, F.lit("."), kind))


def safe_id(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z0-9_-]{1,64}$")


def percent_complete(done: Column, total: Column) -> Column:
    return F.when(total > 0, half_up(done * num(100) / total)).otherwise(F.lit(0))


def fit_within(w: Column, h: Column, edge: int) -> Column:
    """Width and height that fit an edge, aspect kept, at least 1."""
    scale = F.least(num(1), num(edge) / F.greatest(w, h))
    side = lambda x: F.greatest(F.lit(1), half_up(x * scale)).cast("int")
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def original_key(session: Column, photo: Column) -> Column:
    """The key of a stored original."""
    return F.concat_ws(":", session.cast("string"), photo.cast("string"))


def default_name(name: Column, position: Column) -> Column:
    return F.coalesce(F.when(name != "", name), F.concat(F.lit("photo-"), (position + 1).cast("string"), F.lit(".jpg")))


def default_type(mime: Column) -> Column:
    return F.coalesce(F.when(mime != "", mime), F.lit("image/jpeg"))


def upload_status(session: Column, n_files: Column, finalise: Column, known: Column) -> Column:
    """The outcome of an upload request: what is missing first, then whether the session exists."""
    return (
        F.when(session.isNull() | (session == ""), "session id required").when(~safe_id(session), "bad session id")
        .when(~finalise & (n_files == 0), "files required").when(~known, "unknown session").otherwise("ok")
    )


def decode_weights(text: str) -> list[float]:
    """A base64 text of little-endian 32-bit floats as numbers."""
    import base64

    import numpy as np

    return np.frombuffer(base64.b64decode(text), "<f4").astype(float).tolist()
