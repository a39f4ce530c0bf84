"""Repeated passages: found by fingerprints, confirmed by windows, located by Aho-Corasick automata.

A window is ``window`` (50) consecutive words of one document. A word goes when a window that
covers it also starts in a document with a smaller id.

1. Every document gives the minima of its ``seed``-word shingle hashes over each window (winnowing:
   equal windows have equal minima, so a recurring window has a recurring fingerprint).
2. Documents with equal word sequences are one class; all but its smallest id lose everything.
3. Windows with a recurring fingerprint are grouped by their 96-bit hash; those in two documents or
   more are confirmed, and belong to the smallest id. Runs of them are that owner's passages.
4. The passages' aligned ``block``-word pieces (every window inside a passage holds one) are
   compiled into automata with pyahocorasick, one a shard of ``shard_words`` passage words. Every
   document that shares a window with a smaller id streams as a whole, once through each shard that holds an owner
   of its windows; the automaton locates the pieces in it, each is extended word by word along the passage,
   and stretches of a whole window or more go.

What is routed is a shard number for each document and owner, no positions. The documents of a shard are split over
as many tasks as they need (each compiles the shard's automaton), so a passage that a third of all
documents share is no hot spot. What is removed was compared word by word; hashes only choose what
to compare (a window whose 96-bit hash is also that of another one in a smaller id would stay).

Defined results: null texts have no words; texts of fewer words than a window lose nothing;
rows with a null id neither lose words nor count as smaller; exact repeats of a row don't remove
each other (their ids are equal); an empty table gives an empty result. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches
from .words import mixed, shingle_hashes, text_words


@dataclass(frozen=True)
class PhraseParams:
    window: int = 50
    seed: int = 16
    shard_words: int = 100_000
    task_words: int = 400_000

    @property
    def block(self) -> int:
        return self.window // 2


def _minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == w else np.minimum(x[: len(x) - (w - size)], x[w - size :])


def _marks(w: np.ndarray, p: PhraseParams) -> np.ndarray:
    """The fingerprint of every window of a document's word hashes."""
    return _minima(shingle_hashes(w, p.seed), p.window - p.seed + 1)


def _windows(w: np.ndarray, p: PhraseParams) -> list[np.ndarray]:
    """Two independent hashes of every window, of 64 and 32 bits: of 10^13 windows a thousandth of a pair has both alike."""
    far, out = p.window - p.block, []
    for words in (w, mixed(w ^ np.uint64(0xD6E8FEB86659FD93))):
        half = shingle_hashes(words, p.block)
        out.append(mixed(half[: len(half) - far] * np.uint64(0x9E3779B97F4A7C15) + half[far:]))
    return out


def fingerprints(docs: DataFrame, p: PhraseParams, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, sequence, words_sha256, prints): one row a document."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text, hashes in zip(part.column(1).to_pylist(), text_words(part.column(1).cast(pa.string())), strict=True):
                    words = text.split() if text else []
                    joined = b" ".join(words)
                    prints = np.unique(_marks(hashes, p)).view(np.int64) if len(words) >= p.window else np.empty(0, np.int64)
                    rows.append((len(words), xxhash.xxh3_128_digest(joined), hashlib.sha256(joined).hexdigest(), prints))
                lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(r[3]) for r in rows]).astype(np.int32), np.concatenate([r[3] for r in rows]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows]), lists], ["doc_id", "n_words", "sequence", "words_sha256", "prints"])

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, sequence binary, words_sha256 string, prints array<long>")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))


def _confirming(candidates: DataFrame, p: PhraseParams) -> DataFrame:
    """(window, window_2, doc_id, at) of every window with a recurring fingerprint."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for doc, hashes, prints in zip(part.column(0).to_pylist(), text_words(part.column(1).cast(pa.string())), part.column(2), strict=True):
                    if len(hashes) < p.window:
                        continue
                    at = np.flatnonzero(np.isin(_marks(hashes, p).view(np.int64), prints.values.to_numpy()))
                    window, more = (x[at] for x in _windows(hashes, p))
                    yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), pa.array(more.astype(np.uint32).view(np.int32)), pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32))], ["window", "window_2", "doc_id", "at"])

    return candidates.select("doc_id", "text", "prints").mapInArrow(run, "window long, window_2 int, doc_id long, at int")


def _passages(owners: DataFrame, p: PhraseParams) -> DataFrame:
    """(owner, n, text) of every run of windows that a document owns. owners: doc_id, text, own (the places of its windows)."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words, at = text.split(), np.sort(own.values.to_numpy())
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True):
                    piece = words[at[lo] : at[hi - 1] + p.window]
                    if len(piece) >= p.window:  # another row of the same id may be shorter
                        out.append((doc, len(piece), b" ".join(piece)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["owner", "n", "text"])

    return owners.select("doc_id", "text", "own").mapInArrow(run, "owner long, n long, text binary")


class Automaton:
    """Locates stretches of a window or more that a text shares with the passages."""

    def __init__(self, passages: list[tuple[int, bytes]], p: PhraseParams):
        import ahocorasick

        self.p, self.passages, blocks = p, [], {}
        for owner, passage in passages:
            words = passage.decode("utf-8", "surrogateescape").split(" ")
            for at in range(0, len(words) - p.block + 1, p.block):
                blocks.setdefault(" " + " ".join(words[at : at + p.block]) + " ", []).append((len(self.passages), at))
            self.passages.append((owner, words))
        self.machine = ahocorasick.Automaton()
        for block, places in blocks.items():
            self.machine.add_word(block, (len(block), places))
        self.machine.make_automaton()

    def stretches(self, doc: int, text: bytes) -> list[tuple[int, int]]:
        words = [w.decode("utf-8", "surrogateescape") for w in text.split()]
        joined = " " + " ".join(words) + " "
        begins = np.cumsum([0] + [len(w) + 1 for w in words])  # of the blank before each word
        found, past = [], {}
        for end, (size, places) in self.machine.iter(joined):
            at = bisect_left(begins, end - size + 1)
            for number, offset in places:
                owner, own = self.passages[number]
                if owner >= doc or past.get((number, at - offset), -1) >= at + self.p.block:
                    continue
                i, j = at, offset
                while i and j and words[i - 1] == own[j - 1]:
                    i, j = i - 1, j - 1
                e, f = at + self.p.block, offset + self.p.block
                while e < len(words) and f < len(own) and words[e] == own[f]:
                    e, f = e + 1, f + 1
                past[number, at - offset] = e
                if e - i >= self.p.window:
                    found.append((i, e))
        return found


def _located(rows: DataFrame, p: PhraseParams) -> DataFrame:
    """(sequence, first, past) from rows sorted by (shard, salt, is_doc): passages first, then whole documents."""

    def run(batches):
        group, passages, machine = None, [], None
        for batch in batches:
            out = []
            for shard, salt, is_doc, doc, sequence, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (shard, salt) != group:
                    group, passages, machine = (shard, salt), [], None
                if not is_doc:
                    passages.append((doc, text))
                elif passages:
                    machine = machine or Automaton(passages, p)
                    out += [(sequence, a, b) for a, b in machine.stretches(doc, text)]
            types = [pa.binary(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["sequence", "first", "past"])

    return rows.select("shard", "salt", "is_doc", "doc_id", "sequence", "text").mapInArrow(run, "sequence binary, first int, past int")


def _cut(rows: DataFrame) -> DataFrame:
    """(sequence, n_removed, kept_text) from (text, sequence, stretches)."""

    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for text, stretches in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                stay = np.ones(len(words), bool)
                for s in stretches:
                    stay[s["first"] : s["past"]] = False
                removed.append(int((~stay).sum()))
                kept.append(b" ".join(w for w, x in zip(words, stay, strict=True) if x))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["sequence", "n_removed", "kept_text"])

    return rows.select("text", "sequence", "stretches").mapInArrow(run, "sequence binary, n_removed long, kept_text binary")


def repeated_passages(docs: DataFrame, p: PhraseParams = PhraseParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, words_sha256, and kept_text (the kept words joined by blanks) where words were removed."""
    small_batches(docs.sparkSession)
    known = save(fingerprints(docs, p, id_col, text_col), "prints")
    usable = known.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= p.window))
    classes = save(usable.groupBy("sequence").agg(F.min("doc_id").alias("rep")), "classes")
    # Copies of a text are one holder of its fingerprints.
    held = usable.select("doc_id", F.xxhash64("sequence").alias("holder"), F.explode("prints").alias("print"))
    again = save(held.groupBy("print").agg(F.min("holder").alias("lo"), F.max("holder").alias("hi")).where("lo < hi").select("print"), "again")
    per_doc = held.select("doc_id", "print").join(again, "print").groupBy("doc_id").agg(F.collect_set("print").alias("prints"))
    reps = classes.select(F.col("rep").alias("doc_id"), "sequence")
    candidates = _slim(docs, id_col, text_col).join(per_doc.join(reps.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    candidates = save(_own_text(candidates).join(reps, ["doc_id", "sequence"], "left_semi").dropDuplicates(["sequence"]), "candidates")
    windows = _confirming(candidates, p)  # computed twice: cheaper than to keep a row for each window
    window, doc = ["window", "window_2"], F.col("doc_id")
    owned = windows.groupBy(window).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).where("owner < hi")
    owned = save(owned.select(*window, "owner"), "owned")
    marks = windows.join(owned, window).groupBy("doc_id").agg(
        F.collect_list(F.when(doc == F.col("owner"), F.col("at"))).alias("own"), F.collect_set(F.when(doc != F.col("owner"), F.col("owner"))).alias("owners")
    )
    marks = save(marks, "marks")
    texts = candidates.select("doc_id", "sequence", "text")
    passages = save(_passages(texts.join(marks.where(F.size("own") > 0), "doc_id"), p), "passages")
    shards = max(1, -(-(passages.agg(F.sum("n")).first()[0] or 0) // p.shard_words))
    shard = lambda owner: F.pmod(F.xxhash64(owner), F.lit(shards))
    routes = marks.where(F.size("owners") > 0).select("doc_id", F.explode(F.array_distinct(F.transform("owners", shard))).alias("shard"))
    # A text counts with its bytes over six, about its words, so that no text is read to plan the tasks.
    sizes = candidates.select("doc_id", (F.octet_length("text") / 6).alias("n"))
    load = save(routes.join(sizes, "doc_id").groupBy("shard").agg(F.ceil(F.sum("n") / p.task_words).alias("salts")), "load")
    tasks = load.agg(F.sum("salts")).first()[0] or 1
    streamed = texts.join(routes, "doc_id").join(load, "shard").withColumn("salt", F.pmod(F.xxhash64("sequence"), F.col("salts"))).withColumn("is_doc", F.lit(True))
    held = passages.select(F.col("owner").alias("doc_id"), F.lit(None).cast("binary").alias("sequence"), "text", shard("owner").alias("shard")).join(load, "shard")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).withColumn("is_doc", F.lit(False))
    dealt = held.unionByName(streamed).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "is_doc", "doc_id")
    found = save(_located(dealt, p), "stretches")
    cut = _cut(texts.join(found.groupBy("sequence").agg(F.collect_set(F.struct("first", "past")).alias("stretches")), "sequence"))
    judged = save(classes.join(cut, "sequence", "left"), "judged")
    out = known.select("doc_id", "n_words", "sequence", "words_sha256").join(judged, "sequence", "left")
    copy = F.col("doc_id") > F.col("rep")
    first = F.col("doc_id") == F.col("rep")
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(first, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"), "words_sha256",
        F.when(copy, F.lit(b"")).when(first, F.col("kept_text")).alias("kept_text"),
    )


def _own_text(candidates: DataFrame) -> DataFrame:
    """Adds the digest of each text's own words, which tells rows of the same id apart."""

    def run(batches):
        for batch in batches:
            sequences = [xxhash.xxh3_128_digest(b" ".join(t.split())) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequences, pa.binary())], ["doc_id", "text", "prints", "sequence"])

    return candidates.select("doc_id", "text", "prints").mapInArrow(run, "doc_id long, text binary, prints array<long>, sequence binary")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return found.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept_text", 256), "words_sha256").alias("kept_sha256"))
