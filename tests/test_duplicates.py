"""Near-duplicate pairs and their leaders against plain comparisons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import pairs
from siftwell.params import Params
from siftwell.operators import cluster, duplicates, rank
from siftwell.sources import photos as src
from siftwell.sources.tables import materialise

#: The tables' vectors are far apart.
P = Params(same_subject=0.3)
NAMES = ("session_id", "rank", "photo_id", "hash", "color_signature", "taken_at_ms", "embedding")
SCHEMA = "session_id long, rank int, photo_id long, hash string, color_signature array<int>, taken_at_ms long, embedding array<double>"


def frame(spark, rows):
    return spark.createDataFrame([tuple(x[n] for n in NAMES) for x in rows], SCHEMA)


@pytest.fixture(scope="module")
def mixed(spark):
    """Photos of the tables with vectors, hashes and colours missing, cut short or equal, and bursts."""
    r = random.Random(3)
    rows = [row.asDict() for row in rank.rank(rank.score(src.derived_photos(spark, "/root/testdata/sf0.001"))).collect()]
    for x in rows:
        if x["embedding"] and r.random() < 0.3:
            x["embedding"] = x["embedding"][:32]
        if r.random() < 0.1:
            x["hash"] = r.choice((None, "0f", "0" * 64, "f" * 64))
        elif r.random() < 0.5:
            bits = int(r.choice("37ac") * 64, 16)
            for _ in range(r.randint(0, 12)):
                bits ^= 1 << r.randrange(256)
            x["hash"] = f"{bits:064x}"
            x["hash"] = x["hash"].upper() if r.random() < 0.2 else x["hash"]
        if r.random() < 0.1:
            x["color_signature"] = r.choice((None, [], [60, 60]))
        if r.random() < 0.5:
            x["taken_at_ms"] = 1704067200000 + r.randint(0, 90_000)
        if r.random() < 0.5:
            x["color_signature"] = [60 + r.randint(0, 6) for _ in range(32)]
        if r.random() < 0.4:
            x["embedding"] = None
        if r.random() < 0.05:
            x["embedding"] = []
    df = frame(spark, rows)
    return df, {(x.session_id, x.a.rank, x.b.rank) for x in pairs.session_pairs(df, near_only=True, p=P).collect()}


@pytest.mark.parametrize(("block", "pivots"), [(7, 5), (40, 16), (1000, 16)])
def test_indexed_pairs_equal_joined_pairs(spark, mixed, block, pivots):
    df, want = mixed
    got = [tuple(x) for x in duplicates.near_edges(df, P, block=block, pivots=pivots).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 80


def test_no_pairs(spark, mixed):
    df, _ = mixed
    assert duplicates.near_edges(df.limit(0)).count() == 0
    bare = df.withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("color_signature", F.lit(None).cast("array<int>"))
    assert duplicates.near_edges(bare).count() == 0


def test_blocks_that_pivots_rule_out_are_left_out(spark):
    """Vectors in tight clusters far apart: blocks meet their neighbours only, and all pairs are found."""
    r, rows = random.Random(1), []
    for i in range(600):
        around = (i % 12) * math.tau / 12 + r.uniform(-0.05, 0.05)
        rows.append(dict(session_id=1, rank=i + 1, photo_id=i, hash=None, color_signature=None, taken_at_ms=None, embedding=[math.cos(around), math.sin(around)]))
    x = materialise(frame(spark, rows)).withColumn("dims", F.size("embedding")).withColumn("chunks", F.lit(30))
    blocks = duplicates.blocked(x, 20, 16)
    kept, n = duplicates.open_block_pairs(blocks, duplicates.DEFAULT, 16).count(), blocks.select("block").distinct().count()
    assert kept < n * n / 5
    got = {(e.lo, e.hi) for e in duplicates.near_edges(frame(spark, rows), block=20).collect()}
    dot = lambda a, b: a["embedding"][0] * b["embedding"][0] + a["embedding"][1] * b["embedding"][1]
    assert got == {(a["rank"], b["rank"]) for i, a in enumerate(rows) for b in rows[i + 1 :] if dot(a, b) >= 0.9}


def greedy(pairs_of, ranks):
    near = {}
    for lo, hi in pairs_of:
        near.setdefault(hi, []).append(lo)
    lead = {}
    for k in sorted(ranks):
        lead[k] = next((x for x in sorted(near.get(k, [])) if lead[x] == x), k)
    return lead


@pytest.mark.parametrize("per_task", [0, 30, 10**6])
def test_leaders_equal_the_greedy_scan(spark, per_task):
    """In one task, by component, and in rounds: a long chain, random graphs, a star; sessions of every size."""
    r, edges = random.Random(5), []
    edges += [(1, i, i + 1) for i in range(1, 40)]
    edges += [(2, *sorted(r.sample(range(1, 60), 2))) for _ in range(80)]
    edges += [(3, 1, 2)] + [(3, 5, k) for k in range(6, 30)] + [(3, 40 + k, 41 + k) for k in range(0, 20, 2)]
    edges = sorted(set(edges))
    df = materialise(spark.createDataFrame(edges, "session_id long, lo int, hi int"))
    got = {(x.session_id, x["rank"]): x.leader for x in cluster.leaders(df, per_task).collect()}
    want = {}
    for s in (1, 2, 3):
        own = [(a, b) for t, a, b in edges if t == s]
        want |= {(s, k): v for k, v in greedy(own, {x for e in own for x in e}).items() if k != v}
    assert got == want


def test_groups_of_mixed_photos(spark, mixed):
    df, want = mixed
    rows = df.select("session_id", "rank", "photo_id").collect()
    ids = {(x.session_id, x["rank"]): x.photo_id for x in rows}
    expected = {}
    for s in {x.session_id for x in rows}:
        lead = greedy([(a, b) for t, a, b in want if t == s], [x["rank"] for x in rows if x.session_id == s])
        expected |= {ids[s, k]: ids[s, v] for k, v in lead.items()}
    for per_task in (20, 10**6):
        got = cluster.leader_groups(df, P, edges_per_task=per_task, block=50).collect()
        assert {x.photo_id: x.leader_id for x in got} == expected and len(got) == len(rows)
        assert all((x.rank_in_group == 0) == (x.photo_id == x.leader_id) for x in got)


def test_copies_are_compared_once(spark):
    """Hundreds of equal photos are one photo to the comparison; those that are no near-duplicates of themselves stay apart."""
    one = dict(session_id=1, hash="0f" * 32, color_signature=[80] * 4, taken_at_ms=None, embedding=None)
    rows = [one | dict(rank=i + 1, photo_id=i) for i in range(300)]
    rows += [one | dict(rank=301 + i, photo_id=300 + i, embedding=[0.6, 0.8]) for i in range(300)]
    rows += [one | dict(rank=601 + i, photo_id=600 + i, hash="f" * 64) for i in range(3)]
    got = {x.photo_id: (x.leader_id, x.rank_in_group) for x in cluster.leader_groups(frame(spark, rows)).collect()}
    # A photo without a vector is like one with it by its looks.
    assert all(got[i] == (0, i) for i in range(600)) and all(got[600 + i] == (600 + i, 0) for i in range(3))


def test_sessions_without_vectors_or_colours(spark):
    one = dict(hash="0f" * 32, color_signature=[80] * 4, taken_at_ms=None, embedding=None)
    rows = [one | dict(session_id=s, rank=i + 1, photo_id=10 * s + i) for s in (1, 2, 3) for i in range(2)]
    for x in rows:
        if x["session_id"] == 2:
            x["embedding"] = [1.0, 0.0]
        if x["session_id"] == 3:
            x["color_signature"] = None if x["rank"] == 1 else []
    got = {x.photo_id: x.leader_id for x in cluster.leader_groups(frame(spark, rows)).collect()}
    assert got == {10: 10, 11: 10, 20: 20, 21: 20, 30: 30, 31: 31}


def test_hashes_of_one_source_meet_in_few_pairs(spark):
    """Photos of one source share most slices of their hashes; only those that differ in few bits come out, once they are distinct."""
    r = random.Random(8)
    tails = [r.getrandbits(32) for _ in range(60)]
    hashes = [f"{'3a7c' * 14}{t:08x}" for t in [*tails, tails[0] ^ 7]]
    df = frame(spark, [dict(session_id=1, rank=i + 1, photo_id=i, hash=h, color_signature=[60] * 32, taken_at_ms=None, embedding=None) for i, h in enumerate(hashes)])
    slim = df.select("session_id", F.struct("rank", "hash", "color_signature", "taken_at_ms", F.lit(False).alias("has")).alias("side"))
    want = {(i + 1, j + 1) for j, b in enumerate(hashes) for i, a in enumerate(hashes[:j]) if (int(a, 16) ^ int(b, 16)).bit_count() <= P.duplicate_strict}
    found = duplicates.hash_candidates(slim, P).distinct().collect()
    assert (1, 61) in want and len(found) == len(want) and {tuple(x)[-2:] for x in found} == want
