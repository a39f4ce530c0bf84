"""Ranked lexical search over an index of compressed postings.

Building: every task turns its documents into segments of about ``segment_mb`` MB of text. A segment's documents are sorted by
id and numbered; each of its terms has one row with its postings: the numbers of the documents that hold it, as gaps, and how often, as
variable-length bytes. A row without a term holds the documents' ids and sizes. So indexing shuffles nothing, and holds one segment at a time. The index
covers all terms and is a table like any other: it can be kept and searched again.

Searching, for items in blocks of about ``block_terms`` terms: the postings of the block's terms go, segment by segment, to shards. A shard
reads each segment document at a time: a heap holds one cursor for each of an item's terms, keyed by the document it stands at; all
cursors at the smallest document move on together, which gives that document's whole score. The item's result heap holds its ``k`` best documents,
keyed by score, then by id, for all segments of the shard. Terms whose highest possible scores together stay below the worst of k results
can't put a document there on their own: they leave the heap and are only looked up for documents that the other terms name, and only while the result is open. The
shards' results, at most k for each item and shard, are merged for all.

Scores are integers of statistics of the whole corpus, so results don't depend on segments or shards. The block's terms are what is
broadcast: ``block_terms`` rows and those of one item more at most.

Defined results: a document without terms counts for nothing and is never found; repeated rows are documents of
their own; null ids come last among equal scores; items without known terms have no rows; each row of items is an
item, equal or null ids included; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small_batches


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    segment_mb: float = 16.0
    segments_per_shard: int = 2
    most_shards: int = 65_536
    block_terms: int = 200_000
    # the score, in integers
    scale: int = 1_000_000_000
    length_percent: int = 75
    saturation: int = 8


INDEX = "segment string, term string, df long, terms long, postings binary"

#: ASCII that belongs to no term becomes a blank, A-Z become a-z; all bytes beyond ASCII belong to terms.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def _term_lists(texts: pa.Array) -> pa.Array:
    """The terms of each text, in order."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = (texts.buffers()[2].to_pybytes() if texts.buffers()[2] else b"")[offsets[0] : offsets[-1]].translate(_PLAIN)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data))
    return pc.ascii_split_whitespace(plain)


def terms_of(text: str | None) -> list[str]:
    return [t for t in _term_lists(pa.array([text], pa.string())).to_pylist()[0] if t]


def squeezed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as bytes of seven bits, the lowest first, and the length of each."""
    width = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        width += values >= (1 << bits)
    starts = np.cumsum(width) - width
    place = np.arange(width.sum()) - np.repeat(starts, width)
    out = (np.repeat(values, width) >> (7 * place)) & 127
    out[place < np.repeat(width, width) - 1] |= 128
    return out.astype(np.uint8), width


def restored(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(raw):
        return raw
    starts = np.append(0, np.flatnonzero(raw < 128)[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127) << (7 * place), starts)


def _segment(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
    """The index rows of some documents."""
    order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end")
    ids, lists = ids.take(order), _term_lists(texts.take(order))
    flat = pc.list_flatten(lists)
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[some].astype(np.int64)
    if not len(doc):
        return None
    coded = flat.filter(pa.array(some)).dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    sizes = np.bincount(doc, minlength=len(ids))
    posting, tf = np.unique(rank[coded.indices.to_numpy(zero_copy_only=False)] * len(ids) + doc, return_counts=True)
    term, doc = posting // len(ids), posting % len(ids)
    first = np.flatnonzero(np.append(True, np.diff(term) > 0))
    gaps = np.diff(doc, prepend=0)
    gaps[first] = doc[first]
    data, width = squeezed(np.column_stack([gaps, tf]).ravel())
    ends = np.append(0, np.cumsum(width))[np.append(2 * first, 2 * len(term))]
    name, n = uuid.uuid4().hex, len(first)
    # Ids may be null or negative: they are stored as they are, sizes beside them.
    known = np.array([i.is_valid for i in ids]) if ids.null_count else np.ones(len(ids), bool)
    head = np.column_stack([known, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), sizes]).astype("<i8").tobytes()
    postings = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([
        pa.array([name] * (n + 1)), pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary.take(pa.array(by_name)).cast(pa.string())]),
        pa.array(np.append((sizes > 0).sum(), np.diff(np.append(first, len(term))))), pa.array(np.append(sizes.sum(), np.add.reduceat(tf, first))),
        pa.concat_arrays([pa.array([head]), postings]),
    ], ["segment", "term", "df", "terms", "postings"])


def index(docs: DataFrame, p: SearchParams = SearchParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(segment, term, df, terms, postings): sorted by term within a segment; the row without a term tells its documents."""
    small_batches(docs.sparkSession)

    def run(batches):
        held, size = [], 0

        def made():
            out = _segment(pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in held]))
            return [out] if out is not None else []

        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= p.segment_mb * (1 << 20):
                yield from made()
                held, size = [], 0
        if held:
            yield from made()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, INDEX)


class Results:
    """The k best documents of an item, the worst of them at the root."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def least(self) -> int:
        """What a score must reach."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, known: bool, doc: int) -> None:
        entry = (score, known, -doc)  # among equal scores the smallest id is best, a null id worst
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def merge(lists: list[tuple[memoryview, memoryview, int]], docs: list[tuple[bool, int]], best: Results) -> None:
    """Adds one segment's documents to an item's results. lists: a term's document numbers, their scores, and the highest of these."""
    lists = sorted(lists, key=lambda x: x[2])
    upto, total = [], 0  # what a list and all with lower bounds can add together
    for _, _, bound in lists:
        total += bound
        upto.append(total)
    if total < best.least:
        return
    passive = 0  # lists that can't put a document among the results without others
    while passive < len(lists) and upto[passive] < best.least:
        passive += 1
    at = [0] * len(lists)
    cursors = [(lists[i][0][0], i) for i in range(passive, len(lists))]
    heapq.heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            i = cursors[0][1]
            numbers, scores, _ = lists[i]
            score += scores[at[i]]
            at[i] += 1
            if at[i] < len(numbers) and i >= passive:
                heapq.heapreplace(cursors, (numbers[at[i]], i))
            else:
                heapq.heappop(cursors)
        least = best.least
        for i in range(passive - 1, -1, -1):
            if score + upto[i] < least:
                break
            numbers, scores, _ = lists[i]
            # What the heap has passed lies at at[i] or before it; a list that has just become passive may stand beyond doc.
            j = at[i] = bisect_left(numbers, doc, at[i])
            if j < len(numbers) and numbers[j] == doc:
                score += scores[j]
        if score >= least:
            best.add(score, *docs[doc])
            while passive < len(lists) and upto[passive] < best.least:
                passive += 1


def search(indexed: DataFrame, items: DataFrame, p: SearchParams = SearchParams(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item. indexed: a stored index."""
    spark = indexed.sparkSession
    heads = indexed.where("term is null").agg(F.sum("df"), F.sum("terms"), F.count("*")).first()
    n_docs, n_terms, segments = (x or 0 for x in heads)
    schema = "item long, item_id long, doc_id long, score long"
    wanted = items.select(F.monotonically_increasing_id().alias("item"), items[id_col].cast("long").alias("item_id"), items[text_col].alias("text"))
    asked = save(wanted.mapInArrow(_asked, "item long, item_id long, term string, times long"), "search-items")
    counts = indexed.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000) * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    weighed = save(asked.join(counts, "term").withColumn("weight", weight.cast("long")), "search-weights")
    # Buckets of items, and in each of them blocks of items that hold block_terms terms together, or a last item more.
    buckets = max(1, -(-weighed.count() // p.block_terms))
    per_item = weighed.groupBy("item").agg(F.count("*").alias("k")).withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
    upto = F.sum("k").over(Window.partitionBy("bucket").orderBy("item"))
    per_item = per_item.withColumn("part", F.floor((upto - 1) / p.block_terms)).select("item", "bucket", "part")
    weighed = save(weighed.join(per_item, "item"), "search-terms")
    blocks = weighed.select("bucket", "part").distinct().collect()
    shards = max(1, min(p.most_shards, -(-segments // p.segments_per_shard)))
    found = None
    for block in blocks:
        rows = weighed.where((F.col("bucket") == block.bucket) & (F.col("part") == block.part))
        part = _searched(indexed, rows, n_docs, n_terms, shards, p, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("item_id", "rank", "doc_id", "score")


def _asked(batches):
    """The terms of each item and how often it names them."""
    for batch in batches:
        rows = [(item, of, term, n) for item, of, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for term, n in Counter(terms_of(text)).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["item", "item_id", "term", "times"])


def _searched(indexed: DataFrame, rows: DataFrame, n_docs: int, n_terms: int, shards: int, p: SearchParams, schema: str) -> DataFrame:
    """(item, item_id, doc_id, score): the k best documents of each item of a block in each shard."""
    asked: dict[int, tuple[int, list]] = {}
    for r in rows.select("item", "item_id", "term", "times", "weight").collect():
        asked.setdefault(r.item, (r.item_id, []))[1].append((r.term, r.times * r.weight))
    sent = indexed.sparkSession.sparkContext.broadcast(asked)
    terms = F.broadcast(rows.select("term").distinct())

    def run(batches):
        best = {item: Results(p.k) for item in sent.value}
        for heads, postings in _segments(batches):
            docs, length = heads
            by_term = {}
            for term, data in postings:
                pairs = restored(data)
                doc, tf = np.cumsum(pairs[::2]), pairs[1::2]
                part = (p.scale * tf) // (1000 * tf + p.saturation * length[doc])
                by_term[term] = (np.ascontiguousarray(doc).data, part, int(part.max()))
            for item, (_, own) in sent.value.items():
                lists = [(doc, (f * part).data, f * most) for t, f in own if f > 0 and t in by_term for doc, part, most in [by_term[t]]]
                if lists:
                    merge(lists, docs, best[item])
        out = [(item, sent.value[item][0], -doc if known else None, score) for item, results in best.items() for score, known, doc in results.heap]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], ["item", "item_id", "doc_id", "score"])

    def _segments(batches):
        """(documents, their weights of length), and the postings of the block's terms, segment by segment."""
        of, head, held = None, None, []
        for batch in batches:
            for segment, term, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != of:
                    if held:
                        yield head, held
                    of, held = segment, []
                if term is None:
                    raw = np.frombuffer(data, "<i8").reshape(-1, 3)
                    head = [(bool(a), int(b)) for a, b, _ in raw.tolist()], (100 - p.length_percent) + (p.length_percent * raw[:, 2] * n_docs) // max(n_terms, 1)
                else:
                    held.append((term, data))
        if held:
            yield head, held

    wanted = indexed.where("term is not null").join(terms, "term", "left_semi").unionByName(indexed.where("term is null"))
    dealt = wanted.select("segment", "term", "postings").repartition(shards, "segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())
    return dealt.mapInArrow(run, schema)


def ranked(docs: DataFrame, items: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """Indexes all documents and searches them for all items."""
    return search(save(index(docs, p), "search-index"), items, p)
