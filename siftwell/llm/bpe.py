"""Exact byte-pair encoding by one pass over prefixes, and decoding.

The vocabulary is a tokenizer's JSON file (byte-level BPE). A text is cut into pieces as that file says; a piece is
encoded by dynamic programming over its prefixes. An automaton over the whole vocabulary names, at every
position, all tokens that are suffixes of the prefix up to there. Such a token t is the last one of that prefix's encoding
exactly if it stands at the beginning, or if the last token of the prefix before it is compatible with t: if merging by
rank would leave the boundary between both alone. The encoding of a prefix is unique, so one token passes, and it
is all that is stored for the prefix. The ids are read from the back pointers. Time grows with the length of a piece (times
the tokens that end at a position), however long it is; no merge queue is needed.

Two tokens are compatible if no merge across their boundary comes before the merges that hide the boundary's
neighbours: the tokens that stand left of it over time are the last parts of the first token, those right of it the first parts
of the second one. Tokens that merging by rank never makes are left out of the automaton.

The vocabulary has at most ``MOST_TOKENS`` tokens; it is read on the driver and broadcast. Texts cross to
Python once to be encoded and once to be decoded, in their partition; nothing is shuffled. Encoded pieces are remembered in a
table of bounded size.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows and repeated or null ids
are encoded row by row; other columns are not read; an empty table gives an empty result. The strings of added tokens are
those tokens. Ids that the vocabulary lacks are left out in decoding, and bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed value: how the public byte-level pre-tokenizer cuts texts. White space is spelled out: the code points with that Unicode property.
_WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"

MOST_TOKENS = 1 << 20


@dataclass(frozen=True)
class BpeParams:
    #: The tokenizer's JSON file; a bare name is looked up among the installed public tokenizers.
    path: str = "byte_bpe_50k.json"
    #: Pieces and token pairs that a Python worker remembers.
    most_pieces: int = 1 << 18
    most_pairs: int = 1 << 20


def alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it is printable in Latin-1, else the next character from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, merges by rank, and what stands at both ends of a token while it is put together."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE vocabulary")
        if model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("the vocabulary asks for what this encoder does not do")
        if len(model["vocab"]) > MOST_TOKENS:
            raise ValueError(f"more than {MOST_TOKENS} tokens")
        byte_of, ids = alphabet(), model["vocab"]
        self.added: dict[str, int] = {}
        for x in spec.get("added_tokens", []):
            if x["single_word"] or x["lstrip"] or x["rstrip"]:
                raise ValueError("added tokens that take in their surroundings are not known here")
            self.added[x["content"]] = x["id"]
        #: id -> bytes
        self.bytes_of = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        #: (left id, right id) -> rank; id -> (rank, left id, right id)
        self.ranks: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = ids[a + b]
            self.ranks[ids[a], ids[b]] = rank
            if made in self.parts or any(self.parts.get(ids[x], (-1,))[0] >= rank for x in (a, b)):
                raise ValueError("merges must make each token once, and parts before wholes")
            self.parts[made] = (rank, ids[a], ids[b])
        self.reachable = self._reachable(ids[c] for c in byte_of if c in ids)

    def edge(self, token: int, right: bool, until: float = float("inf")) -> list[tuple[int, float]]:
        """The tokens that stand at this end over time, each with the rank of the merge that takes it in."""
        out = [(token, until)]
        while (made := self.parts.get(token)) is not None:
            until, token = made[0], made[2 if right else 1]
            out.append((token, until))
        return out

    def meets(self, left: list[tuple[int, float]], right: list[tuple[int, float]]) -> bool:
        """Whether no merge joins the two sides. Of equal merges that overlap, the one further left comes first."""
        ranks = self.ranks
        for x, gone_x in left:
            for y, gone_y in right:
                rank = ranks.get((x, y))
                if rank is not None and rank < gone_x and rank <= gone_y:
                    return False
        return True

    def _reachable(self, single) -> set[int]:
        """Tokens that merging by rank makes of their own bytes."""
        found = set(single)
        for token, (rank, a, b) in self.parts.items():  # parts come before wholes
            if a in found and b in found and self.meets(self.edge(a, True, rank), self.edge(b, False, rank)):
                found.add(token)
        return found


class Encoder:
    """Text -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, v: Vocabulary, p: BpeParams = BpeParams()):
        import ahocorasick
        import regex

        self.v, self.p = v, p
        self.suffixes = ahocorasick.Automaton()
        for token in v.reachable:
            plain = v.bytes_of[token]
            self.suffixes.add_word(plain.decode("latin-1"), (len(plain), token))
        self.suffixes.make_automaton()
        self.right = {t: v.edge(t, True) for t in v.reachable}
        self.left = {t: v.edge(t, False) for t in v.reachable}
        self.cut = regex.compile(PIECES).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(v.added, key=len, reverse=True))) + ")").split if v.added else lambda text: [text]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= self.p.most_pairs:
                self.pairs.clear()
            found = self.pairs[a, b] = self.v.meets(self.right[a], self.left[b])
        return found

    def piece(self, text: str) -> list[int]:
        """The ids of one piece."""
        plain = text.encode().decode("latin-1")
        last: list[tuple[int, int] | None] = [None] * (len(plain) + 1)  # of each prefix: length and id of its last token
        for end, token in self.suffixes.iter(plain):
            if last[end + 1] is None:
                start = end + 1 - token[0]
                if not start or (before := last[start]) is not None and self.compatible(before[1], token[1]):
                    last[end + 1] = token
        ids, at = [], len(plain)
        while at:
            if last[at] is None:
                raise ValueError("the vocabulary lacks a byte of the text")
            ids.append(last[at][1])
            at -= last[at][0]
        return ids[::-1]

    def of(self, text: str) -> bytes:
        known, out = self.known, []
        for i, part in enumerate(self.split(text)):
            if i % 2:  # an added token
                out.append(np.uint32(self.v.added[part]).astype("<u4").tobytes())
                continue
            for piece in self.cut(part):
                ids = known.get(piece)
                if ids is None:
                    ids = np.array(self.piece(piece), "<u4").tobytes()
                    if len(piece) <= 64:
                        if len(known) >= self.p.most_pieces:
                            known.clear()
                        known[piece] = ids
                out.append(ids)
        return b"".join(out)


class Decoder:
    """Ids as little-endian unsigned 32-bit integers -> text."""

    def __init__(self, v: Vocabulary):
        self.bytes_of = v.bytes_of

    def of(self, ids: bytes) -> str:
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


#: What this Python worker has built, by the vocabulary's digest.
_BUILT: dict = {}


def _built(kind: type, content: bytes, *args):
    key = (kind, hashlib.sha256(content).digest(), *args)
    if key not in _BUILT:
        _BUILT[key] = kind(Vocabulary(content), *args)
    return _BUILT[key]


def vocabulary(path: str) -> bytes:
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, p: BpeParams = BpeParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of each row's whole text, four bytes each, little-endian."""
    spark = docs.sparkSession
    small_batches(spark)
    content = spark.sparkContext.broadcast(vocabulary(p.path))

    def run(batches):
        encoder = _built(Encoder, content.value, p)
        for batch in batches:
            ids = [encoder.of(t) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, p: BpeParams = BpeParams()) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the texts that the ids stand for."""
    spark = tokens.sparkSession
    content = spark.sparkContext.broadcast(vocabulary(p.path))

    def run(batches):
        decoder = _built(Decoder, content.value)
        for batch in batches:
            texts = [decoder.of(x or b"") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def digest(texts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
