"""Cases where the operators once did less than the whole job."""

import random

import numpy as np
from pyspark.sql import functions as F

from siftwell.llm import decontam, tokens
from siftwell.llm.entries import op2_training_order

from .test_operators import EDGES, docs, words


def test_short_and_reworded_items_are_found(spark):
    r = random.Random(8)
    common, n_docs = words(150, 1), 120
    prose = lambda n: [w if r.random() < 0.6 else x for w, x in zip(r.choices(common, k=n), words(n, r.random()), strict=True)]
    items = [prose(r.choice((9, 12, 18, 24, 40))) for _ in range(40)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    texts, want = [], set()
    for i in range(n_docs):
        item = list(items[i % 40])
        if i >= 40:  # a fifth of the words replaced: any, or the rarest
            places = r.sample(range(len(item)), len(item)) if i < 80 else sorted(range(len(item)), key=lambda k: item[k] in common)
            for k in places[: len(item) // 5]:
                item[k] = f"other{i}x{k}"
        texts.append(" ".join(prose(60) + item + prose(60)))
        want.add((i, i % 40))
    got = {(x.doc_id, x.item_id): x for x in decontam.contaminated(docs(spark, *texts), bench).collect()}
    assert want <= set(got)
    assert all(got[i, i].lcs_percent == 100 for i in range(40))


def test_items_are_found_in_capitals(spark):
    item = "Éai éonleeau pour énitre ñasquera ciónmiírr über größe, ênvitre èéèquepaè"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [f"{' '.join(words(40, 1))} {item.upper().replace('SS', 'ß')} {' '.join(words(40, 2))}"]
    assert decontam.contaminated(docs(spark, *texts), bench).first().lcs_percent == 100


def test_training_order_is_read_back_from_its_files(spark, tmp_path):
    p = tokens.TokenParams(length=16, shard=8)
    df = docs(spark, *[" ".join(words(20 + i, i)) for i in range(40)], *EDGES[:6]).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    want = {r.slot: r for r in tokens.training_order(df, p).collect()}
    got = {r.slot: r for r in tokens.materialise(df, p, path=str(tmp_path / "shards")).collect()}
    assert set(got) == set(want) and any(r.first_doc is None for r in want.values())
    for slot, r in got.items():
        assert tuple(r)[:-1] == tuple(want[slot])
        data = open(r.file.removeprefix("file:"), "rb").read()
        assert data[r.byte_offset :][: 2 * p.length] == bytes(r.tokens)
    assert tokens.materialise(df.limit(0), p).count() == 0


def test_training_order_query_writes_its_shards(spark):
    r = op2_training_order(spark, "/root/testdata/sf0.001").where("slot = 5").first()
    data = open(r.file.removeprefix("file:"), "rb").read()
    assert data[r.byte_offset :][: len(r.tokens)] == bytes(r.tokens)


def test_training_order_does_not_depend_on_partitions(spark):
    p = tokens.TokenParams(length=16, shard=8, bin_docs=10)
    texts = [" ".join(words(5 + i % 30, i)) for i in range(60)]
    df = docs(spark, *texts, *texts[:3], None, "", ids=[*range(60), 0, 1, 2, 60, 61]).withColumn("tokens", F.lit("x")).withColumn("bin", F.lit("y"))
    want = None
    for n in (1, 2, 5):
        rows = sorted(tuple(r) for r in tokens.training_order(df.repartition(n), p).collect())
        assert rows and (want is None or rows == want)
        want = rows
    whole = b"".join(bytes(r[-1])[: 2 * r[3]] for r in rows)
    plain = tokens.Encoder(tokens.ranks(p.ranks_path))
    assert len(whole) == sum(len(plain.of(t or "")) + 2 for t in (*texts, *texts[:3], None, ""))


def test_training_order_of_rows_without_ids(spark):
    p = tokens.TokenParams(length=16, shard=8)
    df = docs(spark, "some text", None, "some text").withColumn("doc_id", F.lit(None).cast("long"))
    rows = tokens.training_order(df, p).collect()
    assert len(rows) == 1 and rows[0].first_doc is None and rows[0].n_docs == 3


def plain_slot(i, n, key, rounds):
    """The keyed permutation with plain integers: a balanced Feistel network over an even number of bits, walked until it falls below n."""
    import hashlib

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    m64, mask = (1 << 64) - 1, (1 << half) - 1
    keys = [int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little") for r in range(rounds)]
    x = i
    while True:
        left, right = x >> half, x & mask
        for k in keys:
            z = (right ^ k) * 0x9E3779B97F4A7C15 & m64
            z = (z ^ (z >> 29)) * 0xBF58476D1CE4E5B9 & m64
            left, right = right, left ^ ((z ^ (z >> 32)) & mask)
        x = left << half | right
        if x < n:
            return x


def test_which_documents_stand_in_which_slot(spark):
    """The whole order rebuilt document by document: bins by keyed hash, packed in order, numbered, permuted, cut into shards."""
    p = tokens.TokenParams(length=16, shard=8, bin_docs=7, max_bins=5)
    rows = [(i if i % 9 else None, t) for i, t in enumerate([" ".join(words(i % 23, i)) for i in range(60)] + [None, "", "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = df.selectExpr("xxhash64('training-order', doc_id, text) as place", "doc_id", "text").collect()
    bins, encoder = max(1, min(p.max_bins, -(-len(rows) // p.bin_docs))), tokens.Encoder(tokens.ranks(p.ranks_path))
    packed = []
    for b in range(bins):
        own = sorted((r for r in placed if r.place % bins == b), key=lambda r: (r.place, r.doc_id is not None, r.doc_id or 0))
        stream = [(t, k) for k, r in enumerate(own) for t in [*np.frombuffer(encoder.of(r.text or ""), "<u2").tolist(), p.end]]
        for lo in range(0, len(stream), p.length):
            part = stream[lo : lo + p.length]
            packed.append((len(part), own[part[0][1]].doc_id, len({k for _, k in part}), [t for t, _ in part] + [p.end] * (p.length - len(part))))
    want = {}
    for i, (n_tokens, first, n_docs, ids) in enumerate(packed):
        slot = plain_slot(i, len(packed), p.key, p.rounds)
        want[slot] = (slot // p.shard, slot % p.shard * p.stride, n_tokens, first, n_docs, np.array(ids, "<u2").tobytes())
    got = {r.slot: (r.shard, r.byte_offset, r.n_tokens, r.first_doc, r.n_docs, bytes(r.tokens)) for r in tokens.training_order(df, p).collect()}
    assert got == want and len(got) == len(packed) and len({s for s, *_ in want.values()}) > 3
