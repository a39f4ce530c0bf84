"""WARC archives: written through Spark's sink, read back, continuation records reassembled.

Every page becomes an HTTP response record with chunked transfer framing. A block longer than
``segment`` bytes is cut into a first record and continuation records, which may lie in any
file. Reading groups the continuation records by their origin's identifier, orders them by
segment number, verifies the total length and every digest it finds, and decodes the chunks.
Equal payloads of ``min_revisit`` bytes or more are written once, by the page with the
smallest id; the others become revisit records that name its address, its date and its page.

Files are WARC/1.1 files with a gzip member for each record and a warcinfo record at the head, written by Spark's text
writer: its line separator is a zero byte, the last byte of every member (the high byte of a record's
length, which stays below 16 MB). So any file system that Spark reaches will do, and lost
tasks are written again. A file holds at most ``records_per_file`` records; reading streams
through it record by record. Archives of other writers are read too: plain or gzip, with or without
digests, whole or segmented, chunked or not; their pages have no page_id.

Defined results: a null html is an empty payload; a null page_id sorts before all others when
the smallest is chosen and reads back as null; rows that repeat a page with an equal payload
have the role of that page; an empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, scratch_path, small_batches


@dataclass(frozen=True)
class WarcParams:
    segment: int = 32_768
    chunk: int = 8_192
    min_revisit: int = 0
    records_per_file: int = 2_000
    date: str = "2024-01-01T00:00:00Z"


RECORD = "page_id long, url string, record_type string, origin string, number int, total long, refers_to long, payload_digest string, payload_bytes long, block binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(body: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c := body[i : i + size]), c) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].partition(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        if data[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + n


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member without its very last byte, the zero that the text writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    data = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    if len(data) >= 1 << 24:
        raise ValueError("a record must stay below 16 MB")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return (packer.compress(data) + packer.flush())[:-1]


def _name(*parts: object) -> str:
    name = hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>"


def write(pages: DataFrame, path: str, p: WarcParams = WarcParams(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    small_batches(pages.sparkSession)
    body = F.coalesce(pages[html_col], F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    large = F.octet_length("body") >= p.min_revisit
    first = rows.where(large).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("k")).where("k > 1").select("digest", "first")
    # A saved table on one side lets a very common payload be split on the other.
    roles = rows.join(save(first, "firsts"), "digest", "left")
    revisit = large & F.col("first").isNotNull() & ~F.col("first")["page_id"].eqNullSafe(F.col("page_id"))
    roles = roles.select("page_id", "url", "body", revisit.alias("revisit"), F.col("first")["page_id"].alias("refers_to"), F.col("first")["url"].alias("refers_url"))

    def run(batches):
        task, count, written = TaskContext.get().partitionId(), 0, 0
        plain = lambda url: None if url is None else " ".join(url.split())
        about = b"software: siftwell\r\nformat: WARC File Format 1.1\r\n"
        for batch in batches:
            out = []

            def put(fields, block, out=out):
                nonlocal written
                if written % p.records_per_file == 0:
                    out.append(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _name("info", task, written)), ("WARC-Date", p.date), ("Content-Type", "application/warc-fields")], about))
                    written += 1
                out.append(_record(fields, block))
                written += 1

            for page, url, data, again, target, target_url in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                count += 1
                name, payload = _name(page, task, count), sha1_base32(data)
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                common = [("WARC-Target-URI", plain(url)), ("WARC-Date", p.date), ("Page-ID", page), ("WARC-Payload-Digest", f"sha1:{payload}"), ("Payload-Length", len(data)), ("Content-Type", "application/http; msgtype=response")]
                if again:
                    more = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    more += [("WARC-Refers-To-Target-URI", plain(target_url)), ("WARC-Refers-To-Date", p.date), ("Refers-To-Page-ID", target)]
                    put(more + common + [("WARC-Block-Digest", f"sha1:{sha1_base32(http)}")], http)
                    continue
                block = http + chunked(data, p.chunk)
                parts = [block[i : i + p.segment] for i in range(0, len(block), p.segment)]
                for n, part in enumerate(parts, 1):
                    fields = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", name if n == 1 else _name(page, task, count, n)), *common, ("WARC-Block-Digest", f"sha1:{sha1_base32(part)}")]
                    if len(parts) > 1:
                        fields += [("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", name if n > 1 else None), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)]
                    put(fields, part)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    written = roles.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("maxRecordsPerFile", p.records_per_file).option("lineSep", "\0").text(path)


def unpacked(data: bytes, size: int = 1 << 20):
    """A file's bytes, decompressed piece by piece where it is a row of gzip members."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + size] for i in range(0, len(data), size))
        return
    view, at = memoryview(data), 0
    while at < len(data):
        member, rest = zlib.decompressobj(31), view[at : at + size]
        while not member.eof:
            piece = member.decompress(rest, size)
            at += len(rest) - len(member.unused_data if member.eof else member.unconsumed_tail)
            if piece:
                yield piece
            if not member.eof and not member.unconsumed_tail and at >= len(data):
                raise ValueError("a gzip member is cut off")
            rest = view[at : at + size]


def parse(pieces):
    """(fields in lower case, block) of every record of a WARC file, given in pieces."""
    buffer, source = bytearray(), iter(pieces)

    def need(n: int) -> bool:
        while len(buffer) < n:
            if (piece := next(source, None)) is None:
                return False
            buffer.extend(piece)
        return True

    while need(1):
        end = -1
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not need(len(buffer) + 1):
                raise ValueError("a record's head is cut off")
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        if not need(end + 8 + n) or buffer[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield fields, bytes(buffer[end + 4 : end + 4 + n])
        del buffer[: end + 8 + n]


def _sha1_of(digest: str | None) -> str | None:
    """The bare value of a SHA-1 digest field in base32; other kinds are not checked."""
    kind, _, value = (digest or "").partition(":")
    return value.upper() if kind.lower() == "sha1" and len(value) == 32 else None


def records(spark: SparkSession, path: str) -> DataFrame:
    """The response, revisit and continuation records of the archives in a folder, their block digests verified where they have one."""
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out, size = [], 0
                for f, block in parse(unpacked(batch.column(0)[i].as_py())):
                    if f["warc-type"] not in ("response", "revisit", "continuation"):
                        continue
                    if (digest := _sha1_of(f.get("warc-block-digest"))) and digest != sha1_base32(block):
                        raise ValueError(f"digest of {f['warc-record-id']}")
                    num = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                    out.append((num("page-id"), f.get("warc-target-uri"), f["warc-type"], f.get("warc-segment-origin-id", f["warc-record-id"]), num("warc-segment-number"), num("warc-segment-total-length"), num("refers-to-page-id"), _sha1_of(f.get("warc-payload-digest")), num("payload-length"), block))
                    size += len(block)
                    if len(out) == 256 or size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)

    # Spark leaves out names that begin with a dot or an underscore.
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, without its chunk framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(x.split(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in x.lower() for x in head.split(b"\r\n")[1:])
    return unchunked(body) if framed else body


def _decoded(batches):
    """Verifies and decodes whole blocks: page_id, url, record_type, refers_to, digest, length, payload."""
    for batch in batches:
        c = dict(zip(batch.schema.names, batch.columns, strict=True))
        lengths, digests, payloads = [], [], []
        for kind, block, digest, n in zip(*(c[x].to_pylist() for x in ("record_type", "block", "payload_digest", "payload_bytes")), strict=True):
            payload = None if kind == "revisit" else payload_of(block)
            if payload is not None:
                found = sha1_base32(payload)
                if n not in (None, len(payload)) or digest not in (None, found, sha1_base32(block.partition(b"\r\n\r\n")[2])):
                    raise ValueError("a payload differs from its digest")
                n, digest = len(payload), found
            lengths.append(n)
            digests.append(digest)
            payloads.append(payload)
        yield pa.RecordBatch.from_arrays(
            [c["page_id"], c["url"], pa.array(lengths, pa.int64()), pa.array(digests, pa.string()), c["record_type"], c["refers_to"], pa.array(payloads, pa.binary())],
            ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
        )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives: whole payloads (null for revisits) with type and reference."""
    found = records(spark, path)
    plain = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "block"]
    whole = found.where("number is null").select(*plain)
    parts = found.where("number is not null").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        F.min_by(F.struct("page_id", "url", "refers_to", "payload_digest", "payload_bytes"), "number").alias("head"),
    )
    block = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    numbers = F.transform("parts", lambda x: x["number"]) == F.sequence(F.lit(1), F.size("parts"))
    joined = parts.select("head.*", F.lit("response").alias("record_type"), F.when(numbers & (F.octet_length(block) == F.col("total")), block).otherwise(F.raise_error(F.lit("segments are missing"))).alias("block"))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return whole.unionByName(joined.select(*plain)).mapInArrow(_decoded, schema)


def round_trip(pages: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, p)
    return read(pages.sparkSession, path)
