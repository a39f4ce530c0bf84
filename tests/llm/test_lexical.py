"""Ranked search against scores counted for every document and item."""

import math
import random
import re

import numpy as np
import pytest

from siftwell.llm import lexical
from siftwell.llm.common import save
from siftwell.llm.lexical import SearchParams

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    sets = [(i, terms(t)) for i, t in docs]
    sets = [(i, t) for i, t in sets if t]
    n, total = len(sets), sum(len(t) for _, t in sets)
    df = {}
    for _, t in sets:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, own in sets:
            m = 100 - 75 + (75 * len(own) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * own.count(w)) // (1000 * own.count(w) + 8 * m)) for w in terms(text) if w in own)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if null else doc, -minus) for i, (minus, null, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(docs_df, items_df, p):
    return sorted(map(tuple, lexical.search(save(lexical.index(docs_df, p), "test-index"), items_df, p).collect()), key=repr)


def test_numbers_survive_their_bytes():
    r = np.random.default_rng(1)
    values = np.concatenate([np.arange(300), r.integers(0, 1 << 40, 500), [127, 128, 16383, 16384, 1 << 61]])
    data, width = lexical.squeezed(values)
    assert (lexical.restored(data.tobytes()) == values).all() and width.sum() == len(data) and not len(lexical.restored(b""))


def test_terms_are_the_matches_of_the_pattern():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(chr(r.choice([*range(128), 0x85, 0xA0, 0xE9, 0x130, 0x3000, 0x1F600])) for _ in range(r.randint(0, 40)))
        assert lexical.terms_of(text) == terms(text)
    assert lexical.terms_of(None) == [] == lexical.terms_of(" -- ")


@pytest.mark.parametrize("p", [SearchParams(), SearchParams(k=3, segment_mb=0.002, segments_per_shard=3, block_terms=20), SearchParams(k=1, segment_mb=0.0001, most_shards=2, block_terms=1)])
def test_results_equal_brute_force(spark, p):
    r = random.Random(8)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)] + ["the", "THE", "É", "é"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(150)]
    docs += [(7, docs[7][1]), (None, docs[9][1]), (None, docs[9][1]), (200, None), (201, ""), (202, "?!"), (-5, docs[11][1]), (203, "w1 " * 4000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25)))) for i in range(12)] + [(3, "w1 w2"), (None, "w1 the"), (50, None), (51, "unheard"), (52, "w1 w1 w1 w2")]
    docs_df = spark.createDataFrame([(t, "x", i) for i, t in docs], "text string, term string, doc_id long").repartition(3)
    items_df = spark.createDataFrame([("y", t, i) for i, t in items], "score string, text string, item_id long").repartition(2)
    assert found(docs_df, items_df, p) == brute(docs, items, p.k)


def test_equal_scores_go_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(40, 0, -1)], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "same words")], "item_id long, text string")
    got = found(docs.unionByName(spark.createDataFrame([(99, "other")] * 30, "doc_id long, text string")), items, SearchParams(segment_mb=0.0001))
    assert [x[2] for x in sorted(got, key=lambda x: x[1])] == list(range(1, 11))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(docs.limit(0), items, SearchParams()) == [] == found(docs, items.limit(0), SearchParams())
    assert found(spark.createDataFrame([(1, None)], "doc_id long, text string"), items, SearchParams()) == []


def test_few_candidates_are_scored():
    """Lists that can't lift a document on their own leave the heap: one rare term keeps a common one out of it."""
    every, rare = np.arange(10_000), np.array([5_000])
    common = (every.data, np.full(10_000, 10).data, 10)
    best, seen = lexical.Results(1), []
    add = best.add
    best.add = lambda *x: (seen.append(x), add(*x))
    docs = [(True, i) for i in range(10_000)]
    lexical.merge([common, (rare.data, np.array([100]).data, 100)], docs, best)
    first = len(seen)
    lexical.merge([common, (rare.data, np.array([100]).data, 100)], docs, best)
    assert best.heap == [(110, True, -5_000)] and len(seen) - first == 1
