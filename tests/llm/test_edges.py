"""Nulls, repeats, clashing columns, long texts and hot groups, against brute force where there is one."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from siftwell.llm import common, decontam, neardup, phrases, quality
from siftwell.llm.words import text_words

from .test_operators import brute_passages, docs, words


def brute_components(rows, k=5, percent=75):
    """component of every row of (id, text); null ids stand alone, rows of one id together."""
    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def test_large_buckets_with_several_components(spark):
    """Copies of one text with growing edits: hundreds of texts in the same buckets, in many components, over several blocks."""
    r, base = random.Random(6), words(60, 1)
    rows = []
    for i in range(600):
        w = list(base)
        for k in r.sample(range(60), r.choice((0, 1, 2, 3, 4, 5))):
            w[k] = f"x{r.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    rows += [(700 + i, rows[i % 50][1]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for p in (neardup.NearDupParams(), neardup.NearDupParams(block=40, block_elements=1000, rows_per_task=50)):
        got = {x.doc_id: x.component_id for x in neardup.near_duplicates(df, p=p).collect()}
        assert got == want
    assert len(set(want.values())) > 5


def test_groups_return_forests():
    """A group's links number fewer than its members, whatever its pairs number."""
    p, r = neardup.NearDupParams(), np.random.default_rng(1)
    pool = np.unique(r.integers(0, 1 << 63, 400, np.uint64))
    sets = [np.sort(np.concatenate([pool[i % 3 :], r.integers(0, 1 << 63, 3, np.uint64)])) for i in range(500)]
    regs = neardup.registers_of(sets, p)
    keys = neardup.band_keys(regs, p)
    linked = set()
    for band in np.unique(keys[0]):
        rows = [(i, len(s), regs[i].tobytes(), i, 0) for i, s in enumerate(sets) if band in keys[i]]
        found = list(neardup.Group(rows, band, p).links([sets[x[0]] for x in rows])) if len(rows) > 1 else []
        assert len(found) < max(len(rows), 1)
        linked |= {i for pair in found for i in pair}
    assert len(linked) == 500


def test_near_duplicates_of_null_and_repeated_ids(spark):
    base, other = words(80, 1), words(80, 2)
    near = base[:40] + ["changed"] + base[41:]
    rows = [(None, " ".join(base)), (None, " ".join(base)), (4, " ".join(base)), (4, " ".join(other)), (4, " ".join(base)), (7, " ".join(near)), (9, " ".join(other[:-1])), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("gone", "id", "n", "regs", "set_hash", "component_id", "kept", "__gone_id")})
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(4, 4), (7, 4), (9, 4), (11, 11)}
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [11, 4, 4, 4, None, None]


def test_passages_of_null_and_repeated_ids(spark):
    shared, long = words(55, 1), words(20_000, 2)
    rows = [(3, " ".join(words(10, 3) + shared)), (3, " ".join(shared + words(30, 4))), (5, " ".join(words(60, 5) + shared)), (None, " ".join(shared)), (1, " ".join(words(60, 6))), (8, " ".join(long)), (9, " ".join(long[5000:15_000])), (9, " ".join(long[5000:15_000])), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("prints", "sequence", "print", "owner", "window", "at", "n_words")})
    got = sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in phrases.digest(phrases.repeated_passages(df)).collect()), key=str)
    want = [(d, n, hashlib.sha256(kept.encode()).hexdigest()) for d, n, kept in brute_passages([(d, (t or "").split()) for d, t in rows if d is not None])]
    want += [(None, 0, hashlib.sha256(" ".join(shared).encode()).hexdigest())]
    assert got == sorted(want, key=str)


def test_short_items_are_compared_word_by_word(spark):
    """w47244's 16-bit hash once stood for that of Paris."""
    bench = spark.createDataFrame([(1, "Paris"), (None, "two words")], "item_id long, text string")
    texts = [f"here is w{i} again" for i in range(40_000, 50_000, 4)] + ["in paris, today", "TWO words.", "two other words"]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, *texts), bench).collect()}
    assert got == {(len(texts) - 3, 1), (len(texts) - 2, None)}


def test_contamination_against_every_pair(spark):
    """All documents with all items: what a comparison without any retrieval finds is found."""
    d = "/root/testdata/sf0.001"
    table, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    planted = table.limit(100).collect()
    r, rows = random.Random(4), []
    items = bench.collect()
    for k, row in enumerate(planted):
        item = r.choice(items).text.split()
        for at in r.sample(range(len(item)), len(item) * (k % 4) // 12):
            item[at] = f"other{at}"
        w = (row.text or "").split()
        at = r.randint(0, len(w))
        rows.append((1_000_000 + k, " ".join(w[:at] + item + w[at:])))
    both = table.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    p = decontam.DecontamParams()
    hashed = lambda t: decontam.item_words(pa.array([t], pa.string()))[0]
    known, want = np.zeros(0x10000, bool), set()
    item_words = [(i.item_id, hashed(i.text)) for i in items]
    for row in both.collect():
        w = hashed(row.text)
        want |= {(row.doc_id, k) for k, x in item_words if len(x) >= p.min_item_words and len(w) and decontam._best_stretch(w, x, known, p)}
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(both, bench).collect()}
    assert got == want and len({d for d, _ in want if d >= 1_000_000}) >= 90


def test_clean_columns_survive_clashes(spark):
    bench = spark.createDataFrame([(1, " ".join(words(30, 9)))], "item_id long, text string")
    df = docs(spark, " ".join(words(60, 1)) + ".", " ".join(words(20, 2) + words(30, 9) + words(20, 3)), None, "", "long " * 30_000)
    df = df.withColumns({c: F.lit(c) for c in ("gone", "id", "words", "item_id", "quality", "__gone_id")})
    left = decontam.decontaminated(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [0, 2, 3, 4]
    cleaned = quality.clean(df)
    assert cleaned.columns == df.columns and all(r.quality == "quality" for r in cleaned.collect())
    nobody = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert decontam.decontaminated(nobody, bench).count() == 4
    assert decontam.decontaminated(df.withColumn("doc_id", F.lit(1)), bench).count() == 4


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    class Conf(dict):
        def getConf(self):
            return self

    class Session:
        conf, sparkContext = Conf(), Conf()

    Session.sparkContext.master = "yarn"
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_folder(Session)


def test_words_are_split_and_hashed(spark):
    texts = ["a b", "", None, " \t\n", "a\x0b\x0cb\rA", "é\x1cx\x85y\u00a0z  b", "x" * 200 + " " + "x" * 136 + "y" + "x" * 63, "\x00 \x1f"]
    got = text_words(pa.array(texts), pc.ascii_lower)
    plain = [(t or "").encode().lower().split() for t in texts]
    assert [len(x) for x in got] == [len(x) for x in plain]
    pairs = {(w, int(h)) for ws, hs in zip(plain, got, strict=True) for w, h in zip(ws, hs, strict=True)}
    assert len({w for w, _ in pairs}) == len({h for _, h in pairs}) == len(pairs)
    assert [len(x) for x in text_words(pa.array(texts).slice(4, 2))] == [3, 2] and text_words(pa.array([], pa.string())) == []
    many = [f"{i:x}{'q' * (i % 90)}" for i in range(100_000)]
    assert len(np.unique(text_words(pa.array([" ".join(many)]))[0])) == 100_000
