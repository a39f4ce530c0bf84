"""Spelling variants against a comparison of every word with every word."""

import random
import re
import zlib
from collections import Counter

import pytest

from siftwell.llm import spelling
from siftwell.llm.spelling import SpellingParams


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, x) for x, m in counts.items() if one_edit(w, x)]
        best = min(near, default=(0, None))
        out[w] = (n, len(near), *((best[1], -best[0]) if near and -best[0] >= 2 * n else (None, None)))
    return out


def rooted(formed):
    def root(w):
        while formed[w][2] is not None:
            w = formed[w][2]
        return w

    return {w: (*x, root(w)) for w, x in formed.items()}


def counted_of(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


@pytest.mark.parametrize("most", [1, 4, 64])
def test_pairs_equal_brute_force(spark, most):
    """Few letters, so that buckets are large and repeated letters make many ways to the same edit."""
    r = random.Random(most)
    made = {"".join(r.choice("aab") for _ in range(r.randint(5, 9))): r.randint(3, 50) for _ in range(220)}
    made |= {"commonprefix" + x + "commonsuffix": r.randint(3, 9) for x in ("", "a", "é", "aa", "ab", "ba", "aab", "b")}
    df = spark.createDataFrame(list(made.items()), "word string, n long")
    got = spelling.near_pairs(df, SpellingParams(most=most)).collect()
    pairs = [tuple(sorted((x.a, x.b))) for x in got]
    words = sorted(made)
    assert sorted(pairs) == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))
    assert all(made[x.a] == x.n_a and made[x.b] == x.n_b for x in got)


def test_hot_buckets_are_cut_again(spark):
    """Thousands of words with one first half: the candidates stay near the number of words."""
    r = random.Random(2)
    made = sorted({"samehalf" + "".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(3000)})
    df = spark.createDataFrame([(w, 3) for w in made], "word string, n long")
    got = {(x.a, x.b) for x in spelling.near_pairs(df, SpellingParams(most=16)).collect()}
    rest = {}
    for w in made:
        for i in range(8, 16):
            rest.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    assert got == {(a, b) for same in rest.values() for a in same for b in same if a < b}


def test_variants_of_documents(spark):
    r = random.Random(9)
    base = ["analysis", "analyses", "analyzes", "colour", "colours", "color", "naïveté", "Ünder×word", "short", "four"]
    texts = [" ".join(r.choice(base) + r.choice(["", "", "s", "."]) for _ in range(60)) for _ in range(80)]
    docs = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (7, None), (8, ""), (9, "1 2 -- ?"), (10, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 30_000)]
    df = spark.createDataFrame([(t, "clash", i) for i, t in docs], "text string, word string, doc_id long")
    got = {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in spelling.variants(df).collect()}
    assert got == rooted(brute(counted_of(docs))) and any(x[2] for x in got.values()) and any(len(w) > 10_000 for w in got)
    assert spelling.variants(df.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    """Each form has another one; ties go to the first word."""
    chain = {"aaaaa" + "b" * i: 3 * 2**i for i in range(9)} | {"aaaaac": 6}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in spelling.rooted(spelling.forms(df, spelling.near_pairs(df))).collect()}
    assert got == rooted(brute(chain)) and got["aaaaa"][4] == "aaaaa" + "b" * 8 and got["aaaaa"][2] == "aaaaab"
