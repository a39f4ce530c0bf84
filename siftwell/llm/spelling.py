"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of length L is cut in the middle, at L // 2. One edit leaves one of the two segments as it is, so of two near words
the shorter one (or either, at equal length) is in the index with a segment that the other one has: in the same place, or, where the other is one
longer and the edit lies before it, one place further. Every word is indexed by its two segments and probes with its own
segments for words of its length, and with substrings shifted by the missing character for words one shorter.

What a bucket leaves open is a window: the part that is not known to be equal. A bucket with more than ``most`` indexed words
is not compared pair by pair: its words' windows are cut in the middle again, by the same rule, which puts them into
two of more and smaller buckets each. Windows of at most one character end this, as so few distinct words can differ there: a bound
by the alphabet, whatever the corpus. So no bucket yields all its pairs, and no candidate is lost. Every candidate is verified by its edit distance, and pairs
found more than once count once.

A word's form is its near word of the largest count, if that is at least ``ratio`` times its own; the root is where its forms lead. Counts
grow along forms, so there are no cycles; roots are found by pointer doubling.

Defined results: null and empty texts have no words; a row without an id deletes no code points; repeated rows
and ids count as often as they stand there; ties of the largest count go to the smallest word in code-point order; an empty
table gives an empty result; other columns are not read. All steps are DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"


@dataclass(frozen=True)
class SpellingParams:
    min_length: int = 5
    min_count: int = 3
    #: A bucket with more indexed words is cut again.
    most: int = 64
    #: How many times a word's count its form must have.
    ratio: int = 2
    #: Occurrences whose checksum this divides lose a code point.
    one_in: int = 97


def words(docs: DataFrame, p: SpellingParams = SpellingParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts with their counts."""
    runs = docs.select(docs[id_col].cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate(docs[text_col], UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h, size = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    changed = runs.select(F.when(h % p.one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    return changed.where(F.length("word") >= p.min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= p.min_count)


def _windows(rows: DataFrame, known: Column, lo: Column, hi: Column) -> DataFrame:
    """Rows (key, word, n, longer, lo, hi) for both halves of a window of the shorter word; key: all that is known to be equal."""
    mid = F.floor((lo + hi) / 2).cast("int")
    halves = F.explode(F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))).alias("w")
    x = rows.select("word", "n", "longer", known.alias("length"), halves).select("word", "n", "longer", "length", "w.lo", "w.hi")
    before, after = F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.col("hi") + F.col("longer") + 1, F.length("word"))
    return x.select(F.xxhash64("length", "lo", "hi", before, after).alias("key"), "word", "n", "longer", "lo", "hi")


def near_pairs(counted: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words exactly one inserted, deleted or replaced code point apart, each once."""
    # longer: 0 where a row stands for a word among those of its length, 1 where it looks for words one shorter.
    roles = counted.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    rows = save(_windows(roles, F.length("word") - F.col("longer"), F.lit(0), F.length("word") - F.col("longer")), "spelling-rows")
    found = None
    while True:
        sizes = rows.groupBy("key").agg(F.count_if(F.col("longer") == 0).alias("indexed"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        hot = save(sizes.where((F.col("indexed") > p.most) & (F.col("open") > 1)).select("key"), "spelling-hot")
        more = not hot.isEmpty()
        here = rows.join(hot, "key", "left_anti") if more else rows
        index = here.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        probe = here.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
        near = index.join(probe, "key").where("(longer = 1 or a < b) and levenshtein(a, b, 1) = 1").select("a", "n_a", "b", "n_b")
        near = save(near, "spelling-near")
        found = near if found is None else found.unionByName(near)
        if not more:
            return found.distinct()
        again = rows.join(hot, "key", "left_semi")
        rows = save(_windows(again, F.length("word") - F.col("longer"), F.col("lo"), F.col("hi")), "spelling-rows")


def forms(counted: DataFrame, pairs: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """(word, n, n_near, form, form_n) of all words."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    x = counted.join(best, "word", "left")
    taken = -F.col("best.minus") >= p.ratio * F.col("n")
    return x.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n"))


def rooted(formed: DataFrame) -> DataFrame:
    """Adds root: where a word's forms lead, itself without one."""
    ahead = save(formed.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = save(ahead.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        ahead = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return formed.join(ahead, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, p: SpellingParams = SpellingParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of a corpus."""
    counted = save(words(docs, p, id_col, text_col), "spelling-words")
    formed = save(forms(counted, near_pairs(counted, p), p), "spelling-forms")
    return rooted(formed).select("word", "form", "root", "n", "n_near", "form_n")
