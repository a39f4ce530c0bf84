"""Words of texts as 64-bit hashes, column by column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of k words; for fewer words, one for the whole run."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i]
    return mixed(out)


_TABLE = np.random.default_rng(64).integers(0, 1 << 63, (64, 256), np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """A hash of each word: the sum of random numbers drawn for its bytes and their places, finalised."""
    begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    length, data = np.diff(begin), np.frombuffer(words.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]]
    place = np.arange(len(data)) - np.repeat(begin[:-1] - begin[0], length)
    drawn = _TABLE[place & 63, data] * (2 * (place >> 6) + 1).astype(np.uint64)
    out, full = np.zeros(len(words), np.uint64), length > 0
    if full.any():
        out[full] = np.add.reduceat(drawn, (begin[:-1] - begin[0])[full])
    return mixed(out + length.astype(np.uint64))


def text_words(texts: pa.Array, lower=None, strip: str = "") -> list[np.ndarray]:
    """The hashes of each text's words (between ASCII white space); null is no words.

    lower: a compute function for the case, such as ``pc.ascii_lower``; strip: characters that don't count at a word's ends.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(lower(texts) if lower else texts)
    words = pc.list_flatten(lists).dictionary_encode()
    plain = words.dictionary
    some = pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0
    if strip:
        bare = pc.utf8_trim(plain, strip)
        plain = pc.if_else(pc.equal(bare, ""), plain, bare)
    at = words.indices.to_numpy(zero_copy_only=False)
    some = some[at]
    counts = np.bincount(pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[some], minlength=len(texts))
    return np.split(word_hashes(plain)[at[some]], np.cumsum(counts)[:-1]) if len(texts) else []
