"""All near-duplicate pairs of the sessions, without comparing every photo with every other one.

A pair shows the same in one of three ways, and each has an index of its own.

* Alike hashes, of which at most ``duplicate_strict`` bits differ: of one more slices than that, one is equal (pigeonhole).
* Photos of a burst: times in the same or the next window, and means of their colours, which differ no more than the colours do, in the same or
  the next step.
* Two vectors: the distances to a few pivots differ no more than the vectors do (triangle inequality). A session's vectors lie in
  blocks by nearest pivot and distance; a pair of blocks is compared, as a matrix product, only if no pivot rules out that any of its pairs reaches
  the threshold.

All three are exact. Two photos that both have a vector are judged by these alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.pairs import look_alike, vectors
from ..params import DEFAULT, Params
from ..sources.tables import materialise


#: Rows of a block that are multiplied at a time.
STRIP = 500


def near_edges(ranked: DataFrame, p: Params = DEFAULT, block: int = 4000, pivots: int = 16) -> DataFrame:
    """(session_id, lo, hi): ranks of all near-duplicate pairs of a session."""
    if p.same_subject <= 0:
        raise ValueError("a threshold of 0 makes all vectors near-duplicates")
    photos = materialise(ranked.select("session_id", "rank", "hash", "color_signature", "taken_at_ms", "embedding"))
    slim = photos.select("session_id", F.struct("rank", "hash", "color_signature", "taken_at_ms", F.col("embedding").isNotNull().alias("has")).alias("side"))
    # What is looked up holds ranks and little else; hashes and colours come to the few pairs that are left.
    pairs = hash_candidates(slim, p).unionByName(burst_candidates(slim, p)).distinct()
    side = lambda c, at: slim.select("session_id", F.col("side.rank").alias(at), F.col("side").alias(c))
    looks = pairs.join(side("a", "lo"), ["session_id", "lo"]).join(side("b", "hi"), ["session_id", "hi"]).where(look_alike(p=p)).select("session_id", "lo", "hi")
    return looks.unionByName(vector_edges(photos.where("embedding is not null"), p, block, pivots))


def _met(index: DataFrame, near: DataFrame, keys: list[str], fits: Column) -> DataFrame:
    """(session_id, lo, hi): ranks of rows, as structs a and b, that meet and fit; vectors judge where both have one."""
    pairs = index.join(near, keys).where("a.rank < b.rank and not (a.has and b.has)").where(fits)
    return pairs.select("session_id", F.col("a.rank").alias("lo"), F.col("b.rank").alias("hi"))


def hash_candidates(slim: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(session_id, lo, hi): photos whose hashes differ in few bits; of so many slices not all can differ, so they have one in common."""
    n = p.duplicate_strict + 1
    cuts = [64 * i // n for i in range(n + 1)]
    slices = F.array(*[F.substring("hash", lo + 1, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)])
    whole = slim.where((F.length("side.hash") == 64) & ~S.degenerate(F.col("side.hash"), p)).withColumn("hash", F.lower("side.hash"))
    words = [F.col("hash_words")[i].alias(f"w{i}") for i in range(8)]
    whole = whole.select("session_id", "side.rank", "side.has", "hash", S.hash_words(F.col("hash")).alias("hash_words")).select("session_id", F.struct("rank", "has", *words).alias("side"), "hash")
    index = whole.select("session_id", "side", F.posexplode(slices).alias("i", "slice"))
    bits = sum((F.bit_count(F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}"))) for i in range(8)), F.lit(0))
    return _met(index.withColumnRenamed("side", "a"), index.withColumnRenamed("side", "b"), ["session_id", "i", "slice"], bits <= p.duplicate_strict)


def burst_candidates(slim: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(session_id, lo, hi): photos of a burst, in the same or neighbouring steps of mean colour."""
    size = F.size("side.color_signature")
    mean = F.aggregate("side.color_signature", S.num(0), lambda s, x: s + x) / size
    step = lambda x, width: F.floor(x / S.num(max(width, 1e-9)))
    known = slim.where(F.col("side.taken_at_ms").isNotNull() & (size > 0))
    slight = F.struct("side.rank", "side.has", "side.taken_at_ms").alias("side")
    placed = known.select("session_id", slight, size.alias("size"), step(F.col("side.taken_at_ms"), p.burst_window_ms).alias("time"), step(mean, p.color_loose).alias("shade"))
    around = lambda c: F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])).alias(c)
    near = placed.select("session_id", "side", "size", around("time"), "shade").select("session_id", F.col("side").alias("b"), "size", "time", around("shade"))
    return _met(placed.withColumnRenamed("side", "a"), near, ["session_id", "size", "time", "shade"], F.abs(F.col("a.taken_at_ms") - F.col("b.taken_at_ms")) <= p.burst_window_ms)


def vector_edges(photos: DataFrame, p: Params = DEFAULT, block: int = 4000, pivots: int = 16) -> DataFrame:
    """(session_id, lo, hi) of pairs of vectors of one length whose product reaches the threshold."""
    x = photos.withColumn("dims", F.size("embedding")).where("dims > 0")
    sizes = x.groupBy("session_id", "dims").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    x = x.join(sizes, ["session_id", "dims"])
    few = x.where("chunks = 1").select("session_id", "dims", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("own"), "rank", "embedding")
    if sizes.where("chunks > 1").isEmpty():
        return _products(few, p)
    blocks = blocked(x.where("chunks > 1"), block, pivots)
    pairs = open_block_pairs(blocks, p, pivots)
    sides = pairs.select("session_id", "dims", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("own"))
    many = blocks.select("session_id", "dims", F.col("block").alias("own"), "rank", "embedding").join(sides, ["session_id", "dims", "own"])
    return _products(few.unionByName(many.select(*few.columns)), p)


def blocked(x: DataFrame, block: int, pivots: int) -> DataFrame:
    """Adds each vector's distances to its session's pivots, its norm and its block, a number within the session."""
    place = F.row_number().over(Window.partitionBy("session_id", "dims").orderBy(F.xxhash64("rank"), "rank"))
    at = materialise(x.select("session_id", "dims", "rank", "chunks", "embedding").withColumn("place", place).where(F.col("place") <= pivots))
    chunked = x.withColumn("chunk", F.pmod("rank", "chunks").cast("int"))
    sent = at.select("session_id", "dims", "place", F.col("embedding").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    keys = ["session_id", "dims", "chunk"]

    def run(photos: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(photos):
            return pd.DataFrame({c: [] for c in ("session_id", "dims", "rank", "home", "ring", "far", "norm")})
        v, at = np.stack(photos["embedding"]).astype(float), np.stack(own.sort_values("place")["pivot"]).astype(float)
        far = np.sqrt(np.maximum((v * v).sum(1)[:, None] + (at * at).sum(1) - 2 * v @ at.T, 0))
        home = far.argmin(1)
        ring = np.floor(8 * far[np.arange(len(v)), home]).astype(int)
        return pd.DataFrame({"session_id": photos["session_id"], "dims": photos["dims"], "rank": photos["rank"], "home": home, "ring": ring, "far": list(far), "norm": np.sqrt((v * v).sum(1))})

    schema = "session_id long, dims int, rank int, home int, ring int, far array<double>, norm double"
    placed = materialise(chunked.select(*keys, "rank", "embedding").groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(run, schema))
    # Small cells that follow each other share a block; a large one is dealt over several.
    cells = placed.groupBy("session_id", "dims", "home", "ring").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("session_id", "dims").orderBy("home", "ring")) - F.col("n")
    cells = cells.withColumn("first", F.floor(before / block)).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("n")
    own = placed.join(cells, ["session_id", "dims", "home", "ring"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("rank"), "parts")).cast("int"))
    return materialise(own.select("session_id", "dims", "rank", "far", "norm", "block").join(x.select("session_id", "rank", "embedding"), ["session_id", "rank"]))


def open_block_pairs(blocks: DataFrame, p: Params, pivots: int) -> DataFrame:
    """(session_id, dims, one, two): pairs of blocks that may hold a near-duplicate pair, a block with itself included."""
    ends = [f(F.get("far", F.lit(i))).alias(f"{name}{i}") for i in range(pivots) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    spans = blocks.groupBy("session_id", "dims", "block").agg(F.max("norm").alias("norm"), *ends)
    span = spans.select("session_id", "dims", "block", "norm", F.array(*[f"lo{i}" for i in range(pivots)]).alias("lo"), F.array(*[f"hi{i}" for i in range(pivots)]).alias("hi"))
    side = lambda c: span.select("session_id", "dims", F.struct("block", "norm", "lo", "hi").alias(c))
    gap = F.array_max(F.zip_with(F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, S.num(0))))
    # |a - b| is gap at least, and a * b = (|a|^2 + |b|^2 - |a - b|^2) / 2.
    most = (F.col("a.norm") * F.col("a.norm") + F.col("b.norm") * F.col("b.norm") - F.pow(F.coalesce(gap, S.num(0)), S.num(2))) / 2
    pairs = side("a").join(side("b"), ["session_id", "dims"]).where("a.block <= b.block").where(most >= S.num(p.same_subject - 1e-6))
    return pairs.select("session_id", "dims", F.col("a.block").alias("one"), F.col("b.block").alias("two"))


def _products(sides: DataFrame, p: Params) -> DataFrame:
    """The pairs of two blocks, worked out in strips, so that a task holds the blocks and one strip of products."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        session, _, one, two = key
        a, b = pdf[pdf["own"] == one], pdf[pdf["own"] == two]
        x, y = vectors(a["embedding"])[0], vectors(b["embedding"])[0].T
        found = []
        for lo in range(0, len(x), STRIP):
            i, j = np.nonzero(x[lo : lo + STRIP] @ y >= p.same_subject)
            found.append((a["rank"].to_numpy()[lo + i], b["rank"].to_numpy()[j]))
        left, right = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))
        keep = left < right if one == two else np.ones(len(left), bool)
        return pd.DataFrame({"session_id": session, "lo": np.minimum(left, right)[keep], "hi": np.maximum(left, right)[keep]})

    return sides.groupBy("session_id", "dims", "one", "two").applyInPandas(run, "session_id long, lo int, hi int")
