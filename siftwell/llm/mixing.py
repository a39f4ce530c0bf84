"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

A source's documents stand in a keyed shuffled order, whose words are cut into blocks of equal length
(``block`` words or a little less, so that no shorter block is left over). The mix is a row of slots, each worth a block of its
source. Slot t has the golden-ratio point ``frac(t * 0.618...)``; mapped through the cumulative
shares of the slots that the targets ask for, it names a source, so every prefix of the
schedule is close to the targets. The r-th slot of a source takes its r-th block; past the last block the
source starts over. A source gets as many slots as its target is blocks, rounded: what the points give
beyond that is left out, and what few slots they lack stand at the schedule's end.

Targets: the whole size shared by weight, each source at most ``max_repeats`` times its
own size; what exceeds that is shared again by weight among the rest. With the sources
ordered by (cap / weight) that repeated sharing has a closed form over running sums.

Running positions are two-level sums (hash range, then inside a range); the ranges grow in number
with the documents, so that a source with a third of all rows is spread over many groups. Nothing is broadcast by hand.

Defined results: a null text has size 0; size-0 documents and empty sources take 0 words;
a null source is a source of its own, last in order; repeated rows each keep their own
share; null ids are ids like others; an empty table gives an empty result. Other columns are carried through by
``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, save

#: 2**32 divided by the golden ratio, and its modulus.
GOLDEN, SPAN = 2654435769, 1 << 32


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    max_repeats: int = 3
    block: int = 128
    ranges: int = 1024
    range_docs: int = 50_000
    cells: int = 4096
    chunk: int = 8192
    seed: int = 17


def source_targets(sizes: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """(source, source_size) -> plus weight and target. One row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(p.weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in p.weights]), (at + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * p.max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    w = w.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * free)
    return w.withColumn("target", target).select("source", "source_size", "weight", "target")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def with_blocks(targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Adds the number of blocks, the length of the shorter ones, how many are longer by a word, and the slots wanted."""
    blocks = F.greatest(F.ceil(F.col("source_size") / p.block), F.lit(1))
    t = targets.withColumn("blocks", blocks).withColumn("short", F.floor(F.col("source_size") / F.col("blocks"))).withColumn("longer", F.col("source_size") % F.col("blocks"))
    wanted = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") * F.col("blocks") + 0.5), F.col("blocks") * p.max_repeats)).otherwise(0)
    return t.withColumn("wanted", wanted.cast("long"))


def schedule(targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Slots of the mix: (slot, source, rank), rank counting the source's slots from 0. targets: see ``with_blocks``."""
    spark = targets.sparkSession
    n = targets.agg(F.sum("wanted").alias("n")).first()["n"] or 0
    order = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("wanted").over(order) / F.sum("wanted").over(Window.partitionBy())
    spans = targets.where("wanted > 0").withColumn("hi", upto).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    last = F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1
    spans = spans.withColumn("hi", F.when(last, F.lit(1.0)).otherwise(F.col("hi")))
    cells = spans.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * p.cells), F.least(F.floor(F.col("hi") * p.cells), F.lit(p.cells - 1)))).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("slot"), (F.pmod(F.pmod(F.col("id") + 1, F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(SPAN)) / F.lit(float(SPAN))).alias("x"))
    slots = slots.withColumn("cell", F.floor(F.col("x") * p.cells))
    named = slots.join(cells, "cell").where("x >= lo and x < hi").select("slot", "source", F.floor(F.col("slot") / p.chunk).alias("chunk"))
    counts = named.groupBy("source", "chunk").agg(F.count("*").alias("k"))
    start = F.coalesce(F.sum("k").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source", "chunk", start.alias("start"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = named.withColumn("inside", inside).alias("r")
    given = ranked.join(starts.alias("s"), _same(F.col("r.source"), F.col("s.source")) & (F.col("r.chunk") == F.col("s.chunk"))).select("r.slot", "r.source", (F.col("s.start") + F.col("r.inside")).alias("rank"))
    w = targets.select("source", "wanted").alias("w")
    kept = given.alias("g").join(w, _same(F.col("g.source"), F.col("w.source"))).where(F.col("g.rank") < F.col("w.wanted")).select("g.*")
    # A source's points differ from its share by a few; so many slots follow at the end.
    have = counts.groupBy("source").agg(F.sum("k").alias("have")).alias("h")
    short = w.join(have, _same(F.col("w.source"), F.col("h.source")), "left").select("w.source", "w.wanted", F.coalesce("h.have", F.lit(0)).alias("have")).where("have < wanted")
    more = short.select("source", F.explode(F.sequence("have", F.col("wanted") - 1)).alias("rank"))
    return kept.unionByName(more.select((F.lit(n) + F.col("rank")).alias("slot"), "source", "rank"))


def positions(docs: DataFrame, ranges: int) -> DataFrame:
    """Sized documents (source, size, order_key, ...) with the place ``start`` of each in its source's shuffled row of words."""
    width = (1 << 62) // ranges
    spread = docs.withColumn("range", F.floor(F.shiftrightunsigned("order_key", 2) / F.lit(width)).cast("int"))
    sums = spread.groupBy("source", "range").agg(F.sum("size").alias("part"))
    before = F.coalesce(F.sum("part").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("source", "range", before.alias("base")).alias("b")
    ties = [c for c in docs.columns if c not in ("source", "order_key")]
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "range").orderBy("order_key", *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spread.withColumn("inside", inside).alias("d")
    joined = placed.join(bases, _same(F.col("d.source"), F.col("b.source")) & (F.col("d.range") == F.col("b.range")))
    return joined.select("d.*", (F.col("b.base") + F.col("d.inside")).alias("start")).drop("range", "inside")


def _row_key(docs: DataFrame, p: MixParams, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(p.seed), docs[id_col], docs[text_col])


def _mixed(docs: DataFrame, p: MixParams, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, order_key, taken, first_slot."""
    sized = docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _row_key(docs, p, id_col, text_col).alias("order_key"),
    )
    sized = save(sized, "mix-sized")
    ranges = max(p.ranges, sized.count() // p.range_docs)
    targets = save(with_blocks(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), p), p), "mix-targets")
    t = targets.alias("t")
    placed = positions(sized.where("size > 0"), ranges).alias("p")
    placed = placed.join(t, _same(F.col("p.source"), F.col("t.source"))).select("p.*", "t.source_size", "t.target", "t.short", "t.longer")
    turns = schedule(targets, p).alias("s").join(t, _same(F.col("s.source"), F.col("t.source"))).select("s.source", "slot", (F.col("rank") % F.col("blocks")).alias("block"))
    turns = turns.groupBy("source", "block").agg(F.count("*").alias("times"), F.min("slot").alias("slot")).alias("x")
    # The first ``longer`` blocks have a word more than the others.
    fence = F.col("longer") * (F.col("short") + 1)
    block_of = lambda at: F.when(at < fence, F.floor(at / (F.col("short") + 1))).otherwise(F.col("longer") + F.floor((at - fence) / F.greatest("short", F.lit(1))))
    begin = lambda b: b * F.col("short") + F.least(b, F.col("longer"))
    pieces = placed.withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1))))
    shared = F.least(F.col("start") + F.col("size"), begin(F.col("block") + 1)) - F.greatest(F.col("start"), begin(F.col("block")))
    pieces = pieces.withColumn("shared", shared).alias("q")
    met = pieces.join(turns, _same(F.col("q.source"), F.col("x.source")) & (F.col("q.block") == F.col("x.block")), "left")
    keys = ["doc_id", "source", "size", "source_size", "target", "order_key"]
    one = met.select(*[F.col(f"q.{k}") for k in (*keys, "start")], F.col("shared"), F.col("times"), F.col("slot"))
    worded = one.groupBy(*keys, "start").agg(F.sum(F.col("shared") * F.coalesce(F.col("times"), F.lit(0))).cast("long").alias("taken"), F.min("slot").alias("first_slot")).drop("start")
    empty = sized.where("size = 0").alias("p").join(t, _same(F.col("p.source"), F.col("t.source"))).select("p.*", "t.source_size", "t.target")
    return worded.unionByName(empty.select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot")))


def mix(docs: DataFrame, p: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, and first_slot (where the mix first takes it)."""
    return _mixed(docs, p, id_col, text_col, source_col).drop("order_key")


def mixed_documents(docs: DataFrame, p: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each as often as the mix takes its words; the columns stay as they are.

    A part of a lap counts as a whole copy with a probability equal to that part, drawn from
    a keyed hash of id and text, so the sums stay near the targets; documents without words stay once.
    Rows of equal id and text share what the mix takes of them evenly.
    """
    key, copies, copy = (fresh(n, docs.columns) for n in ("mix_key", "mix_copies", "mix_copy"))
    plan = _mixed(docs, p, id_col, text_col, source_col).groupBy("order_key").agg(F.max("size").alias("size"), F.avg("taken").alias("taken"))
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1.0)
    draw = F.pmod(F.xxhash64(F.lit(p.seed + 1), F.col("order_key")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    plan = plan.select(F.col("order_key").alias(key), F.floor(share + draw).cast("int").alias(copies)).where(F.col(copies) > 0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    met = docs.withColumn(copy, _row_key(docs, p, id_col, text_col)).join(plan, F.col(copy) == F.col(key))
    return met.select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).select(*columns)
