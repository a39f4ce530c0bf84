"""Pixel metrics in relational form: pixels are rows (photo_id, width, height, x, y, r, g, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.scalars import half_up, num


def with_luma(px: DataFrame) -> DataFrame:
    """Adds the luma, held in single precision, and its rounded level 0..255."""
    y = (num(0.299) * F.col("r") + num(0.587) * F.col("g") + num(0.114) * F.col("b")).cast("float").cast("double")
    return px.withColumn("luma", y).withColumn("level", F.least(F.lit(255), F.greatest(F.lit(0), half_up(y))).cast("int"))


def luma_stats(px: DataFrame) -> DataFrame:
    """Brightness, contrast, clipped shares and dynamic range per photo, from counts per level and sums."""
    g = with_luma(px)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    base = g.groupBy("photo_id").agg(
        F.avg("luma").alias("brightness"), F.stddev_pop("luma").alias("contrast"),
        share(F.col("level") <= 2).alias("clipped_shadows"), share(F.col("level") >= 253).alias("clipped_highlights"),
    )
    hist = g.groupBy("photo_id", "level").agg(F.count("*").alias("k"))
    run = hist.withColumn("upto", F.sum("k").over(Window.partitionBy("photo_id").orderBy("level"))).withColumn("total", F.sum("k").over(Window.partitionBy("photo_id")))
    at = lambda q: F.coalesce(F.min(F.when(F.col("upto") >= F.col("total") * num(q), F.col("level"))), F.lit(255))
    ranges = run.groupBy("photo_id").agg((at(0.95) - at(0.05)).cast("double").alias("dynamic_range"))
    return base.join(ranges, "photo_id")


def laplacian(gray: DataFrame, name: str, value: str = "luma") -> DataFrame:
    """(photo_id, name): population variance of the 4-neighbour Laplacian, borders left out, 0 without any."""
    row, col = Window.partitionBy("photo_id", "y").orderBy("x"), Window.partitionBy("photo_id", "x").orderBy("y")
    lap = F.lag(value).over(row) + F.lead(value).over(row) + F.lag(value).over(col) + F.lead(value).over(col) - 4 * F.col(value)
    return gray.withColumn("lap", lap).groupBy("photo_id").agg(F.coalesce(F.var_pop("lap"), num(0)).alias(name))


def center_laplacian(gray: DataFrame) -> DataFrame:
    """The same for the middle quarter of the frame, neighbours outside it included."""
    row, col = Window.partitionBy("photo_id", "y").orderBy("x"), Window.partitionBy("photo_id", "x").orderBy("y")
    lap = F.lag("luma").over(row) + F.lead("luma").over(row) + F.lag("luma").over(col) + F.lead("luma").over(col) - 4 * F.col("luma")
    inside = " and ".join(f"{a} >= floor({n} * 0.25D) and {a} < floor({n} * 0.75D)" for a, n in (("x", "width"), ("y", "height")))
    return gray.withColumn("lap", lap).groupBy("photo_id").agg(F.coalesce(F.var_pop(F.when(F.expr(inside), F.col("lap"))), num(0)).alias("center_sharpness"))


def half_size(gray: DataFrame) -> DataFrame:
    """2x2 box means; a last odd row or column is left out."""
    inside = gray.where("x < 2 * (width div 2) and y < 2 * (height div 2)")
    return inside.groupBy("photo_id", F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y")).agg(F.avg("luma").cast("float").cast("double").alias("luma"))


def focus_metrics(px: DataFrame) -> DataFrame:
    """Sharpness, centre sharpness, focus (free of exposure) and noise ratio."""
    g = with_luma(px)
    sharp = laplacian(g, "sharpness").join(center_laplacian(g), "photo_id").join(laplacian(half_size(g), "half"), "photo_id", "left")
    x = sharp.join(g.groupBy("photo_id").agg(F.stddev_pop("luma").alias("c")), "photo_id")
    square = F.greatest(num(1), F.col("c") * F.col("c"))
    focus = F.greatest("sharpness", "center_sharpness") / square
    ratio = focus / F.greatest(F.coalesce("half", num(0)) / square, num(1e-6))
    return x.select("photo_id", "sharpness", "center_sharpness", focus.alias("focus"), ratio.alias("noise_ratio"))


def colorfulness(px: DataFrame) -> DataFrame:
    """Spread and mean of the opponent colours."""
    rg, yb = F.col("r") - F.col("g"), num(0.5) * (F.col("r") + F.col("g")) - F.col("b")
    x = px.groupBy("photo_id").agg(F.var_pop(rg).alias("vr"), F.var_pop(yb).alias("vy"), F.avg(rg).alias("mr"), F.avg(yb).alias("my"))
    value = F.sqrt(F.greatest(num(0), F.col("vr")) + F.greatest(num(0), F.col("vy"))) + num(0.3) * F.sqrt(F.col("mr") * F.col("mr") + F.col("my") * F.col("my"))
    return x.select("photo_id", value.alias("colorfulness"))


def in_cells(px: DataFrame, columns: int, rows: int) -> DataFrame:
    """Pixels with their grid cells (cx, cy). Cells of small images overlap, so a pixel may come several times."""
    size = px.groupBy("photo_id").agg(F.first("width").alias("width"), F.first("height").alias("height"))

    def cells(n, axis, of, at):
        c = size.select("photo_id", F.col(of).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(at))
        lo = F.floor(F.col(at) * F.col("n") / n).cast("int")
        hi = F.greatest(lo + 1, F.floor((F.col(at) + 1) * F.col("n") / n).cast("int"))
        return c.select("photo_id", at, F.explode(F.sequence(lo, hi - 1)).alias(axis))

    return px.join(cells(columns, "x", "width", "cx"), ["photo_id", "x"]).join(cells(rows, "y", "height", "cy"), ["photo_id", "y"])


def grid(px: DataFrame, columns: int, rows: int) -> DataFrame:
    """(photo_id, cx, cy, v): mean luma of grid cells."""
    return in_cells(with_luma(px), columns, rows).groupBy("photo_id", "cx", "cy").agg(F.avg("luma").alias("v"))


def difference_hash(px: DataFrame, side: int = 16) -> DataFrame:
    """(photo_id, hash): 256 bits, each whether a cell is brighter than its right neighbour, as 64 hex digits."""
    right = F.lead("v").over(Window.partitionBy("photo_id", "cy").orderBy("cx"))
    bits = grid(px, side + 1, side).withColumn("right", right).where(F.col("cx") < side)
    place = F.col("cy") * side + F.col("cx")
    digit = F.sum(F.when(F.col("v") > F.col("right"), F.expr("shiftleft(1, 3 - i % 4)")).otherwise(0))
    digits = bits.withColumn("i", place.cast("int")).withColumn("d", F.expr("i div 4")).groupBy("photo_id", "d").agg(F.lower(F.hex(digit.cast("long"))).alias("h"))
    return digits.groupBy("photo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "h"))), lambda s: s["h"]), "").alias("hash"))


def chroma_signature(px: DataFrame, side: int = 4) -> DataFrame:
    """(photo_id, signature): red and green shares of 16 cells in 255ths; dark cells are neutral."""
    c = in_cells(px, side, side).groupBy("photo_id", "cy", "cx").agg(F.sum("r").alias("r"), F.sum("g").alias("g"), F.sum(F.col("r") + F.col("g") + F.col("b")).alias("t"), F.count("*").alias("n"))
    share = lambda v: F.when(F.col("t") < 12 * F.col("n"), 85).otherwise(half_up(num(255) * F.col(v) / F.col("t"))).cast("int")
    both = c.withColumn("s", F.array(share("r"), share("g"))).groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("cy", "cx", "s"))).alias("all"))
    return both.select("photo_id", F.flatten(F.transform("all", lambda x: x["s"])).alias("signature"))
