"""Training-order materialisation of token ids.

Documents are tokenised and dealt by a keyed hash of id and text into bins; a bin is sorted by that hash and
packed into sequences of ``length`` token ids (16-bit, little-endian), every document ended
by the end token. So what stands in which sequence depends on the documents and the settings alone, not on
partitions, files or the size of a cluster. Sequence number i of N gets
the global slot P(i), where P is a keyed Feistel permutation of a power-of-four domain,
walked along its cycle until it falls below N: a bijection on 0..N-1 that needs no table and
no sort. Slots are range-partitioned into shards of ``shard`` sequences, one file each; the sequence
of slot s lies in shard s // shard at a byte offset of (s % shard) * stride, so a reader resumes at
any slot by arithmetic alone. A record is the 2 * length bytes of its token ids, ``n_tokens``, ``first_doc`` and
``n_docs`` as text of fixed width (a null is blank), and a line feed.

There are at most ``max_bins`` bins, of ``bin_docs`` documents at least: their starts are a table of so many rows, the
only thing that is broadcast. A bin streams through its task, so its size is no matter of memory.

The vocabulary is a file of a public tokenizer, read on the driver and shipped to the tasks
(``ranks_path`` is a parameter).

Defined results: null and empty texts are one end token; a last sequence of a bin that is not
full is padded with the end token (``n_tokens`` tells the real count); repeated rows are
tokenised like others; null ids are ids like others; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, scratch_path, small_batches


@dataclass(frozen=True)
class TokenParams:
    length: int = 1024
    shard: int = 8192
    shards_per_task: int = 2
    bin_docs: int = 4096
    max_bins: int = 65_536
    key: str = "training-order"
    rounds: int = 6
    end: int = 50256
    ranks_path: str = "byte_bpe_multi_50k.tiktoken"

    @property
    def stride(self) -> int:
        """Bytes of a record."""
        return 2 * self.length + sum(WIDTHS.values()) + 1


#: Bytes of the numbers behind the token ids.
WIDTHS = {"n_tokens": 10, "first_doc": 20, "n_docs": 10}
NOT_ALLOWED = "<|not-allowed|>"


def ranks(path: str) -> bytes:
    """The vocabulary file's bytes; a bare name is looked up among the installed public tokenizers."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Text -> its token ids as 16-bit bytes."""

    def __init__(self, vocabulary: bytes):
        import public_tokenizers
        import tiktoken

        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        # Without any special token the library looks for an empty one at every character; this one is never allowed, so its text is encoded like other text.
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={NOT_ALLOWED: max(pairs.values()) + 1})

    def of(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()


def feistel(index: np.ndarray, n: int, key: str, rounds: int = 6) -> np.ndarray:
    """The keyed permutation of 0..n-1, by cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def once(x):
        left, right = x >> h, x & mask
        for k in keys:
            z = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & mask)
        return (left << h) | right

    out = once(index.astype(np.uint64))
    while (out_of := out >= np.uint64(n)).any():
        out[out_of] = once(out[out_of])
    return out.astype(np.int64)


def tokenised(docs: DataFrame, p: TokenParams = TokenParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, doc_id, n, ids): the token ids of each document, compressed, and its keyed place among all."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks(p.ranks_path))

    def run(batches):
        encoder, end = Encoder(vocabulary.value), np.array([p.end], "<u2").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [encoder.of(t or "") + end for t in part.column(2).to_pylist()]
                packed = [pa.compress(x, codec="zstd", asbytes=True) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(packed, pa.binary())], ["place", "doc_id", "n", "ids"])

    doc, text = docs[id_col].cast("long"), docs[text_col]
    slim = docs.select(F.xxhash64(F.lit(p.key), doc, text).alias("place"), doc.alias("doc_id"), text.alias("text"))
    return slim.mapInArrow(run, "place long, doc_id long, n long, ids binary")


def sequences(docs: DataFrame, p: TokenParams = TokenParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin, number, n_tokens, first_doc, n_docs, tokens): packed sequences, numbered within each bin."""
    small_batches(docs.sparkSession)
    bins = max(1, min(p.max_bins, -(-docs.count() // p.bin_docs)))

    def run(batches):
        end, width = np.array([p.end], "<u2").tobytes(), 2 * p.length
        names = ["bin", "number", "n_tokens", "first_doc", "n_docs", "tokens"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        of, number, buffer, first, docs_in, rows = None, 0, b"", None, 0, []

        def last():
            if buffer:
                n = len(buffer) // 2
                rows.append((of, number, n, first, docs_in, buffer + end * (p.length - n)))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for key, doc, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != of:
                    last()
                    of, number, buffer, docs_in = key, 0, b"", 0
                if not buffer:
                    first = doc
                docs_in += 1
                buffer += pa.decompress(ids, decompressed_size=2 * n, codec="zstd", asbytes=True)
                at = 0
                while len(buffer) - at >= width:
                    rows.append((of, number, p.length, first, docs_in, buffer[at : at + width]))
                    number, at, first, docs_in = number + 1, at + width, doc, 1
                buffer = buffer[at:]
                docs_in = docs_in if buffer else 0
                if len(rows) >= 1024:
                    yield flush()
                    rows = []
        last()
        yield flush()

    dealt = tokenised(docs, p, id_col, text_col).withColumn("bin", F.pmod("place", F.lit(bins)).cast("int")).repartitionById(bins, "bin")
    ordered = dealt.sortWithinPartitions("bin", "place", "doc_id").select("bin", "doc_id", "n", "ids")
    return ordered.mapInArrow(run, "bin int, number long, n_tokens int, first_doc long, n_docs int, tokens binary")


def training_order(docs: DataFrame, p: TokenParams = TokenParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences with their place: slot, shard, byte_offset, n_tokens, first_doc, n_docs, tokens; sorted within range partitions."""
    packed = save(sequences(docs, p, id_col, text_col), "sequences", zstd_level=6)
    counts = packed.groupBy("bin").agg(F.count("*").alias("k"))
    n = counts.agg(F.sum("k")).first()[0] or 0
    starts = counts.select("bin", F.coalesce(F.sum("k").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))

    @F.pandas_udf("long")
    def slot(index):
        return index.__class__(feistel(index.to_numpy(), n, p.key, p.rounds))

    @F.pandas_udf("binary")
    def squeezed(tokens):
        return tokens.map(lambda x: pa.compress(x, codec="zstd", asbytes=True))

    @F.pandas_udf("binary")
    def restored(tokens):
        return tokens.map(lambda x: pa.decompress(x, decompressed_size=2 * p.length, codec="zstd", asbytes=True))

    # The token ids cross the exchange compressed: disk is what this takes most of. There are max_bins starts at most.
    placed = packed.join(F.broadcast(starts), "bin").select(slot(F.col("start") + F.col("number")).alias("slot"), "n_tokens", "first_doc", "n_docs", squeezed("tokens").alias("tokens"))
    shards = max(1, -(-n // p.shard))
    dealt = placed.withColumn("shard", F.floor(F.col("slot") / p.shard).cast("int"))
    dealt = dealt.repartitionById(-(-shards // p.shards_per_task), F.floor(F.col("shard") / p.shards_per_task).cast("int"))
    out = dealt.select("slot", "shard", (F.col("slot") % p.shard * p.stride).alias("byte_offset"), "n_tokens", "first_doc", "n_docs", restored("tokens").alias("tokens"))
    return out.sortWithinPartitions("shard", "slot")


def _write(ordered: DataFrame, path: str) -> None:
    numbers = [F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in WIDTHS.items()]
    record = F.concat(F.col("tokens"), *[x.cast("binary") for x in numbers]).cast("string")
    ordered.select("shard", record.alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)


def write_shards(ordered: DataFrame, path: str) -> None:
    """Writes one file a shard: the records of its slots in order.

    The bytes go out through Spark's own text writer, so any file system it knows will do and
    lost tasks are committed once. The folder name tells the shard.
    """
    _write(ordered.repartitionByRange("shard").sortWithinPartitions("shard", "slot"), path)


def read_shards(spark: SparkSession, path: str, p: TokenParams = TokenParams()) -> DataFrame:
    """The rows of training_order as the shard files hold them, cut out by offset, and the file of each."""
    schema = "slot long, shard int, byte_offset long, n_tokens int, first_doc long, n_docs int, tokens binary, file string"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard, data = int(re.search(r"shard=(\d+)", file)[1]), memoryview(content.as_buffer())
                for lo in range(0, len(data), 1024 * p.stride):
                    rows = []
                    for offset in range(lo, min(lo + 1024 * p.stride, len(data)), p.stride):
                        numbers, at = [], offset + 2 * p.length
                        for w in WIDTHS.values():
                            number = bytes(data[at : at + w]).strip()
                            numbers.append(int(number) if number else None)
                            at += w
                        rows.append((shard * p.shard + offset // p.stride, shard, offset, *numbers, bytes(data[offset : offset + 2 * p.length]), file))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def materialise(docs: DataFrame, p: TokenParams = TokenParams(), id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the shard files (in the shared folder where no path is given) and returns their rows, read back from them."""
    path = path or scratch_path(docs.sparkSession, "shards")
    _write(training_order(docs, p, id_col, text_col), path)
    return read_shards(docs.sparkSession, path, p)


def read_slots(spark: SparkSession, path: str, shard: int, first: int, count: int, p: TokenParams = TokenParams()) -> np.ndarray:
    """Token ids of ``count`` sequences of a shard from its ``first`` on, by offsets alone."""
    content = F.substring("content", first * p.stride + 1, count * p.stride)
    data = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shard={shard}").select(content).first()[0])
    return np.frombuffer(data, np.uint8).reshape(-1, p.stride)[:, : 2 * p.length].copy().view("<u2")
