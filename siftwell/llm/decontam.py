"""Benchmark decontamination by latent semantic retrieval.

Texts become rows of hashed words (lower case, outer punctuation stripped). Overlapping
passages of two blocks of ``stride`` words form a TF-IDF matrix A over ``features`` hash buckets
(inverse document frequencies to the power ``idf_power``; words below ``stop_share`` of the
highest one count as stop words); the frequencies come from all passages. One distributed pass gives ``B = A'A W`` for a random
W (features x rank), whose randomised (Nystrom) eigendecomposition yields A's leading right
singular vectors and values. Passages and benchmark items are projected and scaled by
the singular values; documents with a passage of a cosine of ``min_cosine`` or more to an item are
candidates. So that no item is lost where it is shorter than a passage or reworded, documents that
hold enough of an item's rarest words close together are candidates too: whatever passes the
comparison below holds that many, so this side misses nothing.
A candidate counts when the longest common subsequence of the item with a stretch of 1.25 item
lengths covers ``lcs_percent`` of the item, or ``answer_lcs_percent`` and the item's closing
words (its answer) stand in a row at most an item's length away from it.
``cosine`` is the highest of the document's passages, ``first_word`` where the stretch begins.

Sizes: what a task sends on is features x rank numbers, and the driver holds as much; both
are parameters, whatever the corpus. Items are taken in blocks of ``items_per_pass``.

Defined results: null or empty texts match nothing; items with fewer than ``min_item_words``
words are compared only as a whole run of words (they are too short for a passage); a null
item_id is an item like others; repeated rows give repeated matches once per id; an
empty table on either side gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, save, small_batches
from .words import shingle_hashes, text_words

MARKS = ".,;:!?\"'()[]{}<>"


@dataclass(frozen=True)
class DecontamParams:
    stride: int = 16
    features: int = 8192
    rank: int = 96
    idf_power: int = 3
    stop_share: float = 0.3
    min_cosine: float = 0.5
    lcs_percent: int = 75
    answer_lcs_percent: int = 60
    answer_words: int = 6
    min_item_words: int = 8
    items_per_pass: int = 20_000
    seed: int = 5


def item_words(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of each text's words: lower case, outer punctuation stripped."""
    return text_words(texts, pc.utf8_lower, MARKS)


def word_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words): every text as 64-bit word hashes."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w.tobytes() for w in item_words(part.column(1))], pa.binary())], ["id", "words"])

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, "id long, words binary")


def _groups(batch: pa.RecordBatch, p: DecontamParams, most: int = 20_000):
    """The rows of a batch in groups, as (ids, word hashes, offset of each row, begin of each block, row of each block).

    A block has ``stride`` words; a passage is two neighbouring blocks of a row, or its only one.
    """
    ids, rows, size = [], [], 0

    def group():
        offsets = np.cumsum([0] + [len(r) for r in rows])
        blocks = [np.arange(0, len(r), p.stride) for r in rows]
        row = np.repeat(np.arange(len(rows)), [len(b) for b in blocks])
        return ids, np.concatenate(rows), offsets, np.concatenate(blocks) + offsets[row], row

    for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if data:
            ids.append(i)
            rows.append(np.frombuffer(data, np.uint64))
            size += len(rows[-1])
            if size >= most:
                yield group()
                ids, rows, size = [], [], 0
    if rows:
        yield group()


def _passages(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block of every passage, and whether it goes on into the next block."""
    goes_on = np.append(row[1:] == row[:-1], False)
    alone = np.append(True, row[1:] != row[:-1]) & ~goes_on
    first = np.flatnonzero(goes_on | alone)
    return first, goes_on[first]


def _features(words: np.ndarray, p: DecontamParams) -> np.ndarray:
    return (words % np.uint64(p.features)).astype(np.int64)


class Blocks:
    """The weighted words of a group's blocks: the features of each block, filled up with one that weighs nothing."""

    def __init__(self, words: np.ndarray, begin: np.ndarray, weighs: np.ndarray, p: DecontamParams):
        features = np.append(_features(words, p), p.features)
        features[:-1][~weighs[features[:-1]]] = p.features
        index = begin[:, None] + np.arange(p.stride)
        index[np.arange(p.stride) >= np.diff(np.append(begin, len(words)))[:, None]] = len(words)
        self.features = features[index]

    def sums(self, weights: np.ndarray, first: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """Sum of the words' weights (with a last row of zeros), for each passage."""
        blocks = weights[self.features[:, 0]]
        more = np.empty_like(blocks)
        for k in range(1, self.features.shape[1]):
            blocks += np.take(weights, self.features[:, k], axis=0, out=more, mode="clip")
        out = blocks[first]
        out[goes_on] += blocks[first[goes_on] + 1]
        return out

    def by_word(self, blocks: np.ndarray, n: int) -> np.ndarray:
        """For each of n features the sum of the rows of the blocks that hold it, as often as they do."""
        at, place = np.nonzero(self.features < n)
        feature, columns = self.features[at, place], np.ascontiguousarray(blocks.T)
        return np.stack([np.bincount(feature, weights=c[at], minlength=n) for c in columns], axis=1)


def _with_zero(weights: np.ndarray) -> np.ndarray:
    return np.vstack([weights, np.zeros((1, weights.shape[1]), weights.dtype)])


def frequencies(rows: DataFrame, p: DecontamParams) -> tuple[np.ndarray, int]:
    """In how many passages each feature occurs, and the number of passages."""

    def run(batches):
        total, n = np.zeros(p.features, np.int64), 0
        for batch in batches:
            for _, words, offsets, begin, row in _groups(batch, p):
                f = _features(words, p)
                first, _ = _passages(row)
                at = begin[first]
                index = at[:, None] + np.arange(2 * p.stride)
                block = np.where(index < offsets[row[first] + 1][:, None], f[np.minimum(index, len(f) - 1)], -1)
                block.sort(axis=1)
                new = np.concatenate([block[:, :1] >= 0, (block[:, 1:] != block[:, :-1]) & (block[:, 1:] >= 0)], axis=1)
                total += np.bincount(block[new], minlength=p.features)
                n += len(at)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n))], ["feature", "k"])

    got = rows.mapInArrow(run, "feature long, k long").groupBy("feature").agg(F.sum("k").alias("k")).collect()
    out, n = np.zeros(p.features, np.int64), 0
    for r in got:
        if r["feature"] < 0:
            n = r["k"]
        else:
            out[r["feature"]] = r["k"]
    return out, n


def subspace(rows: DataFrame, idf: np.ndarray, p: DecontamParams) -> np.ndarray:
    """Projection (features x rank): word weights times right singular vectors over singular values."""
    test = np.random.default_rng(p.seed).standard_normal((p.features, p.rank)).astype(np.float32)
    weighted, weighs = _with_zero((idf[:, None] * test).astype(np.float32)), idf > 0

    def run(batches):
        total = np.zeros((p.features, p.rank), np.float64)
        for batch in batches:
            for _, words, _, begin, row in _groups(batch, p, 100_000):
                held = Blocks(words, begin, weighs, p)
                first, goes_on = _passages(row)
                y = held.sums(weighted, first, goes_on)
                # A'y: each word gets the sum over the passages that hold it.
                blocks = np.zeros((len(begin), p.rank), np.float32)
                blocks[first] += y
                blocks[first[goes_on] + 1] += y[goes_on]
                total += held.by_word(blocks, p.features)
        seen = np.flatnonzero(total.any(axis=1))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total[seen].astype(np.float32).ravel()), p.rank).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(seen), lists], ["feature", "part"])

    parts = rows.mapInArrow(run, "feature long, part array<float>")
    sums = parts.groupBy("feature").agg(*[F.sum(F.col("part")[i].cast("double")).alias(f"c{i}") for i in range(p.rank)])
    b = np.zeros((p.features, p.rank))
    for r in sums.collect():
        b[r[0]] = r[1:]
    b *= idf[:, None]
    shift = np.sqrt(p.features) * np.finfo(np.float32).eps * max(np.linalg.norm(b), 1e-30)
    b += shift * test
    core = test.T.astype(np.float64) @ b
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, values.max() * 1e-12))
    u, s, _ = np.linalg.svd(b @ root, full_matrices=False)
    singular = np.sqrt(np.maximum(s**2 - shift, s.max() ** 2 * 1e-9))
    return (idf[:, None] * u / singular).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def lcs(a, b) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        u = row & masks.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _holds(text: bytes, part: bytes) -> bool:
    """Whether a run of words, as 64-bit hashes, stands in another."""
    at = text.find(part)
    while at > 0 and at % 8:
        at = text.find(part, at + 1)
    return at >= 0


def _part(words: np.ndarray) -> np.ndarray:
    """16 bits of each word's hash: enough to choose what to compare."""
    return (words >> np.uint64(40) & np.uint64(0xFFFF)).astype(np.int64)


def _rare(texts: list[np.ndarray], df: np.ndarray, p: DecontamParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The items' rarest words: (for each 16-bit part of a word's hash, begin of its items; these items), and for each item how many of them any match holds, and its width.

    A match holds ``least`` per cent of an item's words, so it lacks few; of the rarest words, as many as
    it may lack and ``t`` more, it holds ``t`` at least. Filtering by that loses no match.
    """
    least = min(p.lcs_percent, p.answer_lcs_percent)
    pairs, t = [], np.zeros(len(texts), np.int64)
    for j, words in enumerate(texts):
        n = len(words)
        lacks = n - -(-n * least // 100)
        t[j] = max(1, min(n - lacks, n // 4))
        rarest = np.unique(_part(words[np.argsort(df[_features(words, p)], kind="stable")[: lacks + t[j]]]))
        pairs.append(np.stack([rarest, np.full(len(rarest), j)]))
    word, item = np.concatenate(pairs, axis=1)
    by = np.argsort(word, kind="stable")
    return np.searchsorted(word[by], np.arange(0x10001)), item[by], t, np.array([_width(len(x)) for x in texts])


def _by_words(words: np.ndarray, row_of: np.ndarray, rare: tuple) -> set:
    """(row, item) pairs where a stretch of the item's width holds enough of its rarest words."""
    begin, items, t, width = rare
    words = _part(words)
    k = begin[words + 1] - begin[words]
    at = np.flatnonzero(k)
    k = k[at]
    place = np.repeat(at, k)
    item = items[np.arange(len(place)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[words[at]], k)]
    by = np.argsort(item, kind="stable")
    place, item = place[by], item[by]
    last = np.arange(len(place)) + t[item] - 1
    inside = last < len(place)
    first, last = np.flatnonzero(inside), last[inside]
    good = (item[last] == item[first]) & (row_of[place[last]] == row_of[place[first]])
    good &= place[last] - place[first] < width[item[first]]
    first = first[good]
    return set(zip(row_of[place[first]].tolist(), item[first].tolist(), strict=True))


def _matches(rows: DataFrame, items: list, projection: np.ndarray, df: np.ndarray, p: DecontamParams) -> DataFrame:
    keys = [i["id"] for i in items]
    texts = [np.frombuffer(i["words"], np.uint64) for i in items]
    latent = _unit(np.stack([projection[_features(t, p)].sum(0) for t in texts])).T.astype(np.float32)
    ship = rows.sparkSession.sparkContext.broadcast((keys, [t.tobytes() for t in texts], latent, projection, _rare(texts, df, p)))

    def run(batches):
        keys, texts, latent, projection, rare = ship.value
        arrays = [np.frombuffer(t, np.uint64) for t in texts]
        parts = [_part(t) for t in arrays]
        known, weighs = np.zeros(0x10000, bool), projection.any(axis=1)
        step = max(16, (1 << 22) // len(keys))  # cosines at a time
        padded = _with_zero(projection)
        for batch in batches:
            best = {}
            for ids, words, offsets, begin, block_row in _groups(batch, p):
                first, goes_on = _passages(block_row)
                z = _unit(Blocks(words, begin, weighs, p).sums(padded, first, goes_on))
                row = block_row[first]
                pairs = _by_words(words, np.repeat(np.arange(len(ids)), np.diff(offsets)), rare)
                for lo in range(0, len(z), step):
                    i, j = np.nonzero(z[lo : lo + step] @ latent >= p.min_cosine)
                    pairs.update(zip(row[lo + i].tolist(), j.tolist(), strict=True))
                for r, some in groupby(sorted(pairs), key=itemgetter(0)):
                    text, chosen = words[offsets[r] : offsets[r + 1]], [j for _, j in some]
                    held = _held(text, [parts[j] for j in chosen], known)
                    for j in compress(chosen, (held >= min(p.lcs_percent, p.answer_lcs_percent)).tolist()):
                        got = _best_stretch(text, arrays[j], known, p)
                        if got and got[0] > best.get((ids[r], j), (-1,))[0]:
                            a, b = np.searchsorted(row, (r, r + 1))
                            best[ids[r], j] = (got[0], float((z[a:b] @ latent[:, j]).max()), *got[1:])
            out = [(d, keys[j], *v) for (d, j), v in best.items()]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["doc_id", "item_id", "lcs_percent", "cosine", "first_word", "answer"])

    return rows.mapInArrow(run, "doc_id long, item_id long, lcs_percent long, cosine double, first_word long, answer boolean")


def _width(n: int) -> int:
    """Words of a stretch that is compared with an item of n words."""
    return max(n * 5 // 4, 1)


def _held(row: np.ndarray, items: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """Per cent of each item's words (16-bit parts) that stand anywhere in a row: no stretch of it covers more. ``known`` is left as it is, all false."""
    part, sizes = _part(row), np.array([len(x) for x in items])
    known[part] = True
    held = np.add.reduceat(known[np.concatenate(items)].astype(np.int64), np.cumsum(sizes) - sizes)
    known[part] = False
    return 100 * held // sizes


def _best_stretch(row: np.ndarray, item: np.ndarray, known: np.ndarray, p: DecontamParams) -> tuple | None:
    """(lcs percent, first word, answer) of the stretch of 1.25 item lengths that covers most of the item, or None.

    Every stretch that begins with a word of the item and holds enough of its words is compared; ``known`` is 65536 times false, and left so.
    """
    n, width = len(item), _width(len(item))
    part = _part(item)
    known[part] = True
    hits = known[_part(row)]
    known[part] = False
    sums = np.concatenate([[0], np.cumsum(hits)])
    starts = np.flatnonzero(hits)
    held = 100 * (sums[np.minimum(starts + width, len(row))] - sums[starts]) // n
    by = np.argsort(-held, kind="stable")
    by = by[held[by] >= min(p.lcs_percent, p.answer_lcs_percent)]
    best, items, seen = None, item.tolist(), {}
    for s, most in zip(starts[by].tolist(), held[by].tolist(), strict=True):
        if best and min(most, 100) <= best[0]:
            break
        stretch = row[s : s + width]
        around = row[max(0, s - n) : s + width + n].tobytes()
        # Repeated words give equal stretches again and again.
        if (data := stretch.tobytes()) not in seen:
            seen[data] = 100 * lcs(items, stretch.tolist()) // n
        covered = seen[data]
        if covered < min(p.lcs_percent, p.answer_lcs_percent) or best and covered <= best[0]:
            continue
        answer = _holds(around, item[-p.answer_words :].tobytes())
        if covered >= p.lcs_percent or covered >= p.answer_lcs_percent and answer:
            best = (covered, s, answer)
    return best


def _short(rows: DataFrame, items: list) -> DataFrame:
    """Exact runs of items that are too short for a passage: found by the hash of a run, compared word by word."""
    by_length: dict[int, dict[int, list]] = {}
    for i in items:
        words = np.frombuffer(i["words"], np.uint64)
        key = int(shingle_hashes(words, len(words))[0])
        by_length.setdefault(len(words), {}).setdefault(key, []).append((i["id"], i["words"]))
    ship = rows.sparkSession.sparkContext.broadcast(by_length)

    def run(batches):
        tables = [(n, np.array(sorted(keys), np.uint64), keys) for n, keys in ship.value.items()]
        for batch in batches:
            out = set()
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(data or b"", np.uint64)
                for n, sought, keys in tables:
                    if len(words) >= n:
                        runs = shingle_hashes(words, n)
                        for at in np.flatnonzero(np.isin(runs, sought)).tolist():
                            out.update((doc, k, at) for k, t in keys[int(runs[at])] if words[at : at + n].tobytes() == t)
            first = {}
            for d, k, at in out:
                first[d, k] = min(at, first.get((d, k), at))
            n, pairs = len(first), list(first)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in pairs], pa.int64()), pa.array([o[1] for o in pairs], pa.int64()), pa.array([100] * n, pa.int64()), pa.array([1.0] * n, pa.float64()), pa.array([first[o] for o in pairs], pa.int64()), pa.array([True] * n, pa.bool_())], ["doc_id", "item_id", "lcs_percent", "cosine", "first_word", "answer"])

    return rows.mapInArrow(run, "doc_id long, item_id long, lcs_percent long, cosine double, first_word long, answer boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, lcs_percent, cosine, first_word, answer) of every match."""
    small_batches(docs.sparkSession)
    rows = save(word_rows(docs, id_col, text_col), "word-rows")
    items = save(word_rows(benchmark, item_col, item_text).where("octet_length(words) > 0").withColumn("block", F.lit(0)), "items")
    n_items = items.count()
    df, n = frequencies(rows, p)
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, lcs_percent long, cosine double, first_word long, answer boolean")
    if not n or not n_items:
        return empty
    idf = np.log((1 + n) / (1 + df))
    # Words of a far smaller weight than the rarest ones' are stop words: they weigh nothing.
    idf = np.where(idf >= p.stop_share * idf.max(), idf, 0.0) ** p.idf_power
    projection = subspace(rows, idf, p)
    out, blocks = [], -(-n_items // p.items_per_pass)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("id", "words"), F.lit(blocks)) == k).select("id", "words").collect()
        long = [i for i in block if len(i["words"]) >= 8 * p.min_item_words]
        short = [i for i in block if len(i["words"]) < 8 * p.min_item_words]
        out += [_matches(rows, long, projection, df, p)] if long else []
        out += [_short(rows, short)] if short else []
    found = empty
    for x in out:
        found = found.unionByName(x)
    best = F.max(F.struct("lcs_percent", "cosine", "first_word", "answer")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that match no benchmark item; the columns stay as they are.

    Each row is judged by its own text, with or without an id, whatever other rows have its id.
    """
    gone, key = fresh("gone", docs.columns), fresh("row_key", docs.columns)
    hashed = F.xxhash64(docs[id_col], docs[text_col])
    ids = contaminated(docs.select(hashed.alias("doc_id"), docs[text_col].alias("text")), benchmark, p).select(F.col("doc_id").alias(gone)).distinct()
    return docs.withColumn(key, hashed).join(ids, F.col(key) == F.col(gone), "left_anti").drop(key)
