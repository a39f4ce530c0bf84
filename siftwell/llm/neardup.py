"""Near-duplicate documents by SetSketch registers, verified on full shingle sets.

A document's set holds its distinct k-word shingles (lower-cased A-Z only), each as a
64-bit hash. Register i of a sketch is the truncated exponentially spaced minimum
``floor(1 - log_b(min_i))`` of exponential variates over the set, so registers merge by
maximum and are equal with a probability close to the Jaccard similarity (b near 1).
Four registers make a band; documents that share a band value are candidates. Their
similarity is first estimated by maximum likelihood from both sketches and the known set
sizes; those not clearly below the threshold are then checked on the full sets.

Documents with equal sets are one class, so copies never multiply. A bucket of any size
gives a star (each member with the smallest id) first. Then, only in buckets whose members
lie in different components, the members are compared block by block: a block holds about
``block`` members and ``block_elements`` set elements, and each pair of blocks is a group of its
own, so no bucket is taken into one task as a whole and no candidate is dropped. A group
holds the full sets, verifies there, and skips members that its links already join, so it
returns a spanning forest of its links (fewer rows than members), never its pairs. A pair is
looked at in the first band only that it shares, and before full sets are fetched, the same groups
drop all members without any probable partner, by registers alone.

Band settings: at similarity 0.75 a pair shares none of the 32 bands of 4 registers with a
probability of 5e-6; the estimate's margin of 0.2 is over 4 standard deviations.

Defined results: null and empty texts, and texts of white space, have an empty set and
link with nothing; a text with fewer words than a shingle is one shingle; rows with a null
id are left out of links and returned with a null component and kept = true; rows that
repeat an id count as one document for links and are all returned. Extra columns of the
input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, save, small_batches
from .components import components
from .words import mixed, shingle_hashes, text_words


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    top: int = (1 << 16) - 2
    margin: float = 0.2
    block: int = 2048
    block_elements: int = 1 << 20
    rows_per_task: int = 1_500
    seed: int = 11

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def text_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted set of k-word shingles of each text, A-Z in lower case."""
    return [np.unique(shingle_hashes(w, k)) for w in text_words(texts, pc.ascii_lower)]


def _multipliers(p: NearDupParams) -> np.ndarray:
    return np.random.default_rng(p.seed).integers(0, 1 << 63, p.registers, np.uint64) * np.uint64(2) + np.uint64(1)


def registers_of(sets: list[np.ndarray], p: NearDupParams) -> np.ndarray:
    """Registers (one row a set) of non-empty sets."""
    out = np.empty((len(sets), p.registers), np.uint64)
    mult, at = _multipliers(p), 0
    while at < len(sets):  # about 64k elements at a time stay in the processor's cache
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= 65_536:
            size += len(sets[end])
            end += 1
        joined = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        for i, m in enumerate(mult):
            out[at:end, i] = np.minimum.reduceat(joined * m, starts)
        at = end
    least = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64) / p.rate
    return np.clip(np.floor(1 - np.log(np.maximum(least, 1e-300)) / np.log(p.base)), 0, p.top + 1).astype(np.uint16)


def _likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float):
    """Log-likelihood of the Jaccard similarity of pairs of sketches with known set sizes: a concave function."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def p_b(x):
        return -np.log1p(-np.maximum(x, 0) * (base - 1) / base) / np.log(base)

    def value(j):
        pa_, pb_ = p_b(u - v * j), p_b(v - u * j)
        eps = 1e-12
        return more * np.log(pa_ + eps) + less * np.log(pb_ + eps) + same * np.log(np.maximum(1 - pa_ - pb_, eps))

    return value, np.minimum(u / v, v / u)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes."""
    value, hi = _likelihood(a, b, na, nb, base)
    lo = np.zeros(len(hi))
    for _ in range(30):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = value(x) < value(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    return (lo + hi) / 2


def _likely(a, b, na, nb, p: NearDupParams) -> np.ndarray:
    """Whether the estimate reaches the threshold less the margin: whether the likelihood still rises there."""
    out = 100 * np.minimum(na, nb) >= p.percent * np.maximum(na, nb)
    if out.any():
        value, _ = _likelihood(a[out], b[out], na[out].astype(float), nb[out].astype(float), p.base)
        at = p.percent / 100 - p.margin
        out[out] = value(np.full(int(out.sum()), at)) <= value(np.full(int(out.sum()), at + 1e-3))
    return out


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearDupParams = NearDupParams()) -> DataFrame:
    """(doc_id, n_shingles, set_hash, regs): one row a document; the last two are null for an empty set."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = text_sets(part.column(1), p.shingle)
                full = [s for s in sets if len(s)]
                regs = iter(registers_of(full, p)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_hash", "regs"],
                )

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, regs binary")


def full_sets(docs: DataFrame, id_col: str, text_col: str, p: NearDupParams) -> DataFrame:
    """(doc_id, set_hash, elements): the sorted 64-bit set of each document, as bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [x.tobytes() for x in text_sets(part.column(1), p.shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "set_hash", "elements"])

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, set_hash binary, elements binary")


def band_keys(regs: np.ndarray, p: NearDupParams) -> np.ndarray:
    """A key for each band of each row of registers."""
    regs = regs.reshape(len(regs), p.bands, p.rows)
    salt = mixed(np.arange(1, p.bands + 1, dtype=np.uint64))
    key = np.zeros(regs.shape[:2], np.uint64)
    for i in range(p.rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, i].astype(np.uint64) + salt)
    return key.view(np.int64)


def _banded(reps: DataFrame, p: NearDupParams) -> DataFrame:
    """(band, id, n): a row for each band of each class."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column(2)), p)
                ids, ns = (np.repeat(batch.column(i).to_numpy(), p.bands) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids), pa.array(ns)], ["band", "id", "n"])

    return reps.select("id", "n", "regs").mapInArrow(run, "band long, id long, n long")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _probable(pairs: DataFrame, reps: DataFrame, p: NearDupParams) -> DataFrame:
    """Pairs whose sketches don't speak against them."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c = dict(zip(batch.schema.names, batch.columns, strict=True))
                keep = _likely(_matrix(c["ra"]), _matrix(c["rb"]), c["na"].to_numpy(), c["nb"].to_numpy(), p)
                yield pa.RecordBatch.from_arrays([c["a"].filter(pa.array(keep)), c["b"].filter(pa.array(keep))], ["a", "b"])

    held = reps.select("id", "n", "regs")
    for x in ("a", "b"):
        pairs = pairs.withColumnRenamed(x, "id").join(held, "id").withColumnsRenamed({"id": x, "n": "n" + x, "regs": "r" + x})
    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """Pairs that reach the threshold on their full sets, with the sizes that show it."""

    def run(batches):
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(batch.column(i) for i in range(4)), strict=True):
                a, b = a.as_py(), b.as_py()
                s = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                s.sort()
                shared = int((s[1:] == s[:-1]).sum())
                union = len(s) - shared
                if shared * 100 >= p.percent * union:
                    found.append((a, b, shared, union))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["a", "b", "shared", "total"])

    held = sets.select("doc_id", "elements")
    for x in ("a", "b"):
        pairs = pairs.withColumnRenamed(x, "doc_id").join(held, "doc_id").withColumnsRenamed({"doc_id": x, "elements": "e" + x})
    return pairs.select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long, shared long, total long")


class Group:
    """The members of two blocks of a bucket, from rows of id, n, regs, comp, own (the block) and, where links are wanted, elements."""

    def __init__(self, rows: list[tuple], band: int, p: NearDupParams):
        self.p = p
        self.ids, self.sizes, self.comps, self.blocks = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 3, 4))
        self.regs = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), -1)
        # A pair is looked at in the first band that it shares; at the lowest similarity let through, far fewer registers agree by chance.
        self.band = int(np.argwhere(band_keys(self.regs, p) == band)[0, 1])
        self.least = max(1, int(p.registers * (p.percent / 100 - p.margin) / 2))
        self.one_block = self.blocks.min() == self.blocks.max()

    def probable(self, i: int, labels: np.ndarray) -> np.ndarray:
        """The members after i, of another label, whose sketches don't speak against a link with i."""
        js = np.arange(i + 1, len(self.ids))
        js = js[(labels[js] != labels[i]) & (self.one_block | (self.blocks[js] != self.blocks[i]))]
        if len(js):
            equal = self.regs[js] == self.regs[i]
            enough = equal.sum(1) >= self.least
            js, equal = js[enough], equal[enough]
        if len(js):
            js = js[equal.reshape(len(js), self.p.bands, self.p.rows).all(2).argmax(1) == self.band]
        if len(js):
            js = js[_likely(np.broadcast_to(self.regs[i], (len(js), self.p.registers)), self.regs[js], np.full(len(js), self.sizes[i]), self.sizes[js], self.p)]
        return js

    def with_partner(self) -> np.ndarray:
        """Which members any probable link concerns."""
        out = np.zeros(len(self.ids), bool)
        for i in range(len(self.ids) - 1):
            js = self.probable(i, self.comps)
            out[js] = True
            out[i] |= len(js) > 0
        return out

    def links(self, sets: list[np.ndarray]):
        """A spanning forest of the links between members of different components."""
        labels, begin = self.comps.copy(), np.cumsum([0] + [len(x) for x in sets])
        universe, elements = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(universe), bool)
        for i in range(len(self.ids) - 1):
            js = self.probable(i, labels)
            if not len(js):
                continue
            own = elements[begin[i] : begin[i + 1]]
            mark[own] = True
            if len(js) * 8 > len(self.ids):
                shared = np.add.reduceat(mark[elements], begin[:-1], dtype=np.int64)[js]
            else:
                shared = np.array([mark[elements[begin[j] : begin[j + 1]]].sum() for j in js], np.int64)
            mark[own] = False
            for j in js[100 * shared >= self.p.percent * (self.sizes[i] + self.sizes[js] - shared)]:
                if labels[j] != labels[i]:
                    labels[labels == labels[j]] = labels[i]
                    yield min(self.ids[i], self.ids[j]), max(self.ids[i], self.ids[j])


def _by_group(dealt: DataFrame, columns: list[str], schema: str, found, p: NearDupParams) -> DataFrame:
    """found(rows, key), a record batch, for each group of band, x, y of a sorted table."""

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for band, x, y, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if (band, x, y) != key:
                    if len(rows) > 1:
                        yield found(rows, key)
                    key, rows = (band, x, y), []
                rows.append(row)
        if len(rows) > 1:
            yield found(rows, key)

    return dealt.select("band", "x", "y", *columns).mapInArrow(run, schema)


def _spread(members: DataFrame, p: NearDupParams) -> DataFrame:
    """(band, x, y, id, n, comp, own): members of buckets that hold several components, once for each pair of blocks with theirs. members: band, id, n, comp."""
    sized = members.groupBy("band").agg(F.count("*").alias("k"), F.sum("n").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    parts = F.greatest(F.ceil(F.col("k") / p.block), F.ceil(F.col("size") / p.block_elements))
    own = members.join(save(sized.select("band", parts.alias("parts")), "buckets"), "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return spread.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "n", "comp", "own")


def _dealt(groups: DataFrame, rows: int, p: NearDupParams) -> DataFrame:
    """Groups in tasks by the number of rows: the work lies in the comparisons, not in the bytes."""
    return groups.repartition(max(1, -(-rows // p.rows_per_task)), "band", "x", "y").sortWithinPartitions("band", "x", "y")


def _with_partners(groups: DataFrame, rows: int, p: NearDupParams) -> DataFrame:
    """The rows (without registers) of groups of band, x, y, id, n, regs, comp, own that a probable link of their group concerns."""
    names = ["band", "x", "y", "id", "n", "comp", "own"]

    def found(rows, key):
        kept = [r for r, k in zip(rows, Group(rows, key[0], p).with_partner(), strict=True) if k]
        columns = [[k] * len(kept) for k in key] + [[r[i] for r in kept] for i in (0, 1, 3, 4)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return _by_group(_dealt(groups, rows, p), ["id", "n", "regs", "comp", "own"], ", ".join(f"{n} long" for n in names), found, p)


def _across(groups: DataFrame, rows: int, p: NearDupParams) -> DataFrame:
    """Links (a, b) inside groups of band, x, y, id, n, regs, comp, own, elements."""

    def found(rows, key):
        pairs = list(Group(rows, key[0], p).links([np.frombuffer(r[5], np.uint64) for r in rows]))
        return pa.RecordBatch.from_arrays([pa.array([int(f[i]) for f in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    return _by_group(_dealt(groups, rows, p), ["id", "n", "regs", "comp", "own", "elements"], "a long, b long", found, p).distinct()


def _candidates(members: DataFrame, held: DataFrame, comps: DataFrame, p: NearDupParams) -> DataFrame:
    """(band, x, y, id, n, comp, own): members with a probable link to one of another component, in their groups."""
    placed = members.select("band", "id", "n").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    spread = save(_spread(save(placed, "placed"), p), "blocks")
    return save(_with_partners(spread.join(held, ["id", "n"]), spread.count(), p), "partners")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearDupParams = NearDupParams()) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    known = save(sketch(docs, id_col, text_col, p), "sketches")
    usable = known.where("doc_id is not null and set_hash is not null")
    # An id that is repeated with different sets stands for all of them in links.
    first = usable.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n_shingles", "regs")).alias("x"))
    reps = save(first.select(F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), "x.regs", "set_hash"), "reps")
    bands = save(_banded(reps, p), "bands", "lz4")
    full = save(bands.groupBy("band").agg(F.count("*").alias("k"), F.min("id").alias("lead")).where("k > 1").select("band", "lead"), "buckets")
    members = save(bands.join(full, "band"), "members")
    held = save(reps.join(members.select("id").distinct(), "id", "left_semi"), "held")
    stars = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    likely = save(_probable(stars, held, p), "likely")
    # Full sets are needed at probable links only: those of the stars, and those between what the stars leave apart.
    ends = likely.select(F.col("a").alias("id")).union(likely.select("b"))
    wanted = save(ends.union(_candidates(members, held, components(likely), p).select("id")).distinct(), "wanted")
    sets = save(full_sets(_only(docs, wanted.withColumnRenamed("id", "doc_id"), id_col, text_col), "doc_id", "text", p), "sets", "uncompressed")
    links = save(_verified(likely, sets, p).select("a", "b"), "links")
    comps = components(links)
    spread = _candidates(members.join(wanted, "id", "left_semi"), held, comps, p)
    rows = spread.count()
    if rows:
        groups = spread.join(held, ["id", "n"]).join(sets.withColumnRenamed("doc_id", "id"), ["id", "set_hash"])
        comps = components(links.unionByName(save(_across(groups, rows, p), "further")))
    classes = reps.select("set_hash", F.col("id").alias("rep")).join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("comp", "rep").alias("component"))
    out = known.select("doc_id", "n_shingles", "set_hash").join(classes, "set_hash", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _only(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts of these ids, equal rows once."""
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("hash", F.xxhash64("text"))
    return slim.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "hash"]).drop("hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearDupParams = NearDupParams()) -> DataFrame:
    """The documents without all but one of each near-duplicate group; the columns stay as they are.

    Rows of one id are one document: they stay or go together. Rows without an id stay.
    """
    gone = fresh("gone", docs.columns)
    ids = near_duplicates(docs, id_col, text_col, p).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, docs[id_col].cast("long") == F.col(gone), "left_anti")
