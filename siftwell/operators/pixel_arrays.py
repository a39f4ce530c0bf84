"""Pixel metrics in array form: an image is one row (photo_id, width, height, data), data being rows of r, g, b bytes.

One image is measured where it lies, without a shuffle; the tests hold the metrics against relational ones, pixels being rows. An image that can't be measured gives a row with
an error and no metrics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import small_batches

NUMBERS = ("brightness", "contrast", "clipped_shadows", "clipped_highlights", "dynamic_range", "sharpness", "center_sharpness", "focus", "noise_ratio", "colorfulness")
MEASURED = "photo_id long, " + ", ".join(f"{c} double" for c in NUMBERS) + ", hash string, signature array<int>, error string"


def pixels_of(width: int, height: int, data: bytes) -> np.ndarray:
    if not width or not height or len(data) != width * height * 3:
        raise ValueError("not an image")
    return np.frombuffer(data, np.uint8).reshape(height, width, 3).astype(np.float64)


def luma(rgb: np.ndarray) -> np.ndarray:
    """Held in single precision, counted on in double."""
    return (0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]).astype(np.float32).astype(np.float64)


def _laplacian(y: np.ndarray) -> np.ndarray:
    """Of the inner pixels."""
    return y[1:-1, :-2] + y[1:-1, 2:] + y[:-2, 1:-1] + y[2:, 1:-1] - 4 * y[1:-1, 1:-1]


def _variance(x: np.ndarray) -> float:
    return float(x.var()) if x.size else 0.0


def _edges(n: int, parts: int) -> list[tuple[int, int]]:
    return [(c * n // parts, max(c * n // parts + 1, (c + 1) * n // parts)) for c in range(parts)]


def measure_one(rgb: np.ndarray) -> tuple:
    """All numbers, the difference hash and the colour signature of one image."""
    height, width = rgb.shape[:2]
    y = luma(rgb)
    level = np.clip(np.floor(y + 0.5), 0, 255).astype(np.int64)
    upto = np.cumsum(np.bincount(level.ravel(), minlength=256))
    at = lambda q: int(np.argmax(upto >= y.size * q)) if upto[-1] >= y.size * q else 255
    lap = _laplacian(y) if min(width, height) > 2 else np.empty((0, 0))
    top, bottom, left, right = (int(np.floor(n * q)) for n in (height, width) for q in (0.25, 0.75))
    middle = lap[max(top - 1, 0) : max(bottom - 1, 0), max(left - 1, 0) : max(right - 1, 0)]
    half = y[: height // 2 * 2, : width // 2 * 2].reshape(height // 2, 2, width // 2, 2).mean(axis=(1, 3)).astype(np.float32).astype(np.float64)
    sharp, center, contrast = _variance(lap), _variance(middle), float(y.std())
    square = max(1.0, contrast * contrast)
    focus = max(sharp, center) / square
    noise = focus / max((_variance(_laplacian(half)) if min(half.shape) > 2 else 0.0) / square, 1e-6)
    rg, yb = rgb[..., 0] - rgb[..., 1], 0.5 * (rgb[..., 0] + rgb[..., 1]) - rgb[..., 2]
    colorful = float(np.sqrt(rg.var() + yb.var()) + 0.3 * np.sqrt(rg.mean() ** 2 + yb.mean() ** 2))
    cells = np.array([[y[a:b, c:d].mean() for c, d in _edges(width, 17)] for a, b in _edges(height, 16)])
    signature = []
    for a, b in _edges(height, 4):
        for c, d in _edges(width, 4):
            cell = rgb[a:b, c:d].reshape(-1, 3)
            total = cell.sum()
            signature += [85, 85] if total < 12 * len(cell) else [int(np.floor(255 * s / total + 0.5)) for s in cell[:, :2].sum(0)]
    numbers = (float(y.mean()), contrast, float((level <= 2).mean()), float((level >= 253).mean()), float(at(0.95) - at(0.05)), sharp, center, focus, noise, colorful)
    return (*numbers, np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes().hex(), signature)


def measure(images: DataFrame) -> DataFrame:
    """photo_id with all metrics, or with an error. Other columns of images than width, height and data stay beside them."""
    kept = [f for f in images.schema if f.name not in ("photo_id", "width", "height", "data")]

    def run(batches):
        types = [pa.int64(), *[pa.float64()] * len(NUMBERS), pa.string(), pa.list_(pa.int32()), pa.string()]
        names = ["photo_id", *NUMBERS, "hash", "signature", "error"]
        for batch in batches:
            out = []
            for photo, width, height, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    out.append((photo, *measure_one(pixels_of(width, height, data)), None))
                except (TypeError, ValueError) as e:
                    out.append((photo, *[None] * (len(NUMBERS) + 2), str(e)))
            yield pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], t) for i, t in enumerate(types)), *batch.columns[4:]], [*names, *(f.name for f in kept)])

    small_batches(images.sparkSession)
    schema = ", ".join([MEASURED, *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])
    return images.select(F.col("photo_id").cast("long"), "width", "height", "data", *[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def model_input(rgb: np.ndarray, side: int = 256) -> np.ndarray:
    """Planes (3, side, side) of the centre square, nearest pixels, in 0..1."""
    height, width = rgb.shape[:2]
    scale = side / min(width, height)
    cut = [min(n, int(np.floor(side / scale + 0.5))) for n in (height, width)]
    rows, columns = (np.minimum(n - 1, (n - c) // 2 + np.arange(side) * c // side) for n, c in zip((height, width), cut, strict=True))
    return (rgb[rows][:, columns].transpose(2, 0, 1) / 255).astype(np.float32)


def embed(images: DataFrame, load_model: Callable[[], Callable[[np.ndarray], np.ndarray]], side: int = 256, batch_mb: float = 32.0) -> DataFrame:
    """(photo_id, embedding, error): a model's vector of every image, at length 1 (a zero vector stays).

    load_model runs once in each Python worker and returns a function from a stack of planes (n, 3, side, side) to n vectors. A
    stack holds up to ``batch_mb`` MB. Where the model fails on a stack, its images are tried one by one, so an error is that of its own photo.
    """
    most = max(1, int(batch_mb * (1 << 20) // (12 * side * side)))

    def vectors_of(model, stack: list[np.ndarray]) -> list[tuple[list[float] | None, str | None]]:
        try:
            raw = np.asarray(model(np.stack(stack)), np.float64)
            if raw.ndim != 2 or len(raw) != len(stack):
                raise ValueError(f"the model gave shape {raw.shape} for {len(stack)} images")
            norms = np.sqrt((raw * raw).sum(1))
            return [((v / (n or 1.0)).tolist(), None) for v, n in zip(raw, norms, strict=True)]
        except Exception as e:  # whatever a model raises
            if len(stack) == 1:
                return [(None, str(e) or type(e).__name__)]
        return [x for one in stack for x in vectors_of(model, [one])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load_model()
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                photos, found, stack, at = part.column(0).to_pylist(), [(None, None)] * part.num_rows, [], []
                for i, (width, height, data) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    try:
                        stack.append(model_input(pixels_of(width, height, data), side))
                        at.append(i)
                    except (TypeError, ValueError) as e:
                        found[i] = (None, str(e))
                for i, x in zip(at, vectors_of(model, stack) if stack else [], strict=True):
                    found[i] = x
                yield pa.RecordBatch.from_arrays([pa.array(photos, pa.int64()), pa.array([x[0] for x in found], pa.list_(pa.float64())), pa.array([x[1] for x in found], pa.string())], ["photo_id", "embedding", "error"])

    small_batches(images.sparkSession)
    return images.select(F.col("photo_id").cast("long"), "width", "height", "data").mapInArrow(run, "photo_id long, embedding array<double>, error string")
