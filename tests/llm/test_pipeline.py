"""The pipeline's stages, each against a brute-force version on its own input."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import decontam, neardup, tokens
from siftwell.llm.sql import OP5

from .test_edges import brute_components
from .test_operators import targets_of, words


def prose(n, seed):
    w = words(n, seed)
    return "\n".join(" ".join(w[i : i + 12]) + "." for i in range(0, n, 12))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, out = random.Random(12), str(tmp_path_factory.mktemp("tables"))
    items = [words(30, 900 + i) for i in range(5)]
    texts = [prose(r.randint(30, 200), i) for i in range(60)]
    texts += [texts[i].replace(".", "!", 1) for i in range(0, 20, 2)] + [texts[3]] * 3
    texts += [prose(60, 500 + i) + "\n" + " ".join(items[i % 5]) + "." for i in range(8)]
    texts += [None, "", "too short", "spam " * 80, "home | news | about | help | more\n" * 9 + "some words here", prose(40, 700) + "\nclick here to read more", "long " * 5000]
    rows = [(i, t, "en", ("web", "book", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    import corpus_pipeline as c

    stages, seen = dict(c.STAGES), {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in stages.items():
        docs = stage(spark, docs, folder)
        docs.write.parquet(path := f"{folder}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        assert name == "token shards" or docs.columns == columns
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({OP5}) where kept").fetchall()}
    first = seen["quality rules"]
    assert {r.doc_id for r in first} == kept and len(kept) == len(first) and 60 < len(kept) < 90
    comps = brute_components([(r.doc_id, r.text) for r in first])
    second = seen["near dedup"]
    assert sorted(r.doc_id for r in second) == sorted(i for i, x in comps.items() if i == x) and len(second) < len(first)
    p, known = decontam.DecontamParams(), np.zeros(0x10000, bool)
    hashed = lambda t: decontam.item_words(pa.array([t], pa.string()))[0]
    items = [hashed(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    third = seen["decontamination"]
    assert {r.doc_id for r in third} == {r.doc_id for r in second if not any(decontam._best_stretch(hashed(r.text), x, known, p) for x in items)}
    assert len(third) < len(second)
    own, sizes, taken = {}, {}, {}
    for r in third:
        sizes[r.doc_id] = len(r.text.split())
        own[r.source] = own.get(r.source, 0) + sizes[r.doc_id]
    fourth = seen["mixture"]
    for r in fourth:
        taken[r.source] = taken.get(r.source, 0) + sizes[r.doc_id]
    target = targets_of(own)
    assert all(abs(taken[s] - target[s]) <= 4 * max(sizes.values()) for s in own)
    assert {tuple(r) for r in fourth} <= {tuple(r) for r in third} and max(sum(r.doc_id == x.doc_id for x in fourth) for r in fourth) <= 3
    fifth, encoder = seen["token shards"], tokens.Encoder(tokens.ranks(tokens.TokenParams().ranks_path))
    assert sorted(r.slot for r in fifth) == list(range(len(fifth)))
    assert sum(r.n_tokens for r in fifth) == sum(len(encoder.of(r.text)) // 2 + 1 for r in fourth)
    assert c.run(spark, folder).count() == len(fifth)


def test_stages_on_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, docs, folder).write.parquet(path := str(tmp_path / str(k)))
        found = spark.read.parquet(path)
        assert found.count() == 0
        docs = found if k < 3 else docs


def test_stages_carry_other_columns(spark, folder):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'a' as taken", "'b' as gone", "'c' as mix_key", "'d' as kept", "'e' as row_key", "'f' as quality")
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.where("taken = 'a' and gone = 'b' and kept = 'd'").count() == out.count() > 0
    assert c.STAGES[-1][1](spark, docs, folder).count() > 0


def test_params_of_near_duplicates():
    p = neardup.NearDupParams()
    assert (p.shingle, p.percent) == (5, 75)
