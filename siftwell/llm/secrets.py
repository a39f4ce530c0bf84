"""Secret scans over an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its content. A ledger, a table of
Parquet parts at a path of its own, holds for each (blob, rules version) that was ever scanned what was
found. A run hashes all versions, takes the blobs that the ledger lacks under the current rules
(each once, however many paths hold it), fetches and scans only those, appends them to the
ledger, and joins the ledger's findings back to all paths. A run over versions that are all known
reads no content beyond hashing it and scans nothing; a new rules version scans every blob once more and
leaves the older findings in place. Runs that overlap may scan a blob twice; readers take it once.

Rules: the three base rules (assign, access, hex) and four more with a shape of their own
(private key blocks, and three token formats). Positions are code points, end exclusive.

Defined results: a null content counts as empty; an empty text has no findings; a null path is
a path like others; repeated rows each get their findings; an empty table gives an empty
result and scans nothing. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, small_batches

#: Fixed patterns of the base rules, and their least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Published shapes of other secrets.
MORE = (
    ("private_key", "PRIVATE KEY", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----.*?(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----|\Z)", re.DOTALL)),
    ("forge_token", "_", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat_token", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("signed_token", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")),
)
KINDS = ("assign", "access", "hex", *(m[0] for m in MORE))
RULES_VERSION = "1"
LEDGER = "blob binary, rules string, findings array<struct<start:int,kind:int,end:int>>"


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for i, (_, anchor, rule) in enumerate(MORE, 3):
        if anchor in text:
            found += [(m.start(), i, m.end()) for m in rule.finditer(text)]
    return sorted(found)


def blob_of(content: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")), 256))


class Ledger:
    """What was found in every blob that was scanned so far, by rules version, kept at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self, rules: str | None = None) -> DataFrame:
        """(blob, rules, findings), each blob once; empty where nothing was ever scanned."""
        try:
            found = self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException:
            found = self.spark.createDataFrame([], LEDGER)
        return found if rules is None else found.where(F.col("rules") == rules)

    def unseen(self, versions: DataFrame, content: str = "content", rules: str = RULES_VERSION) -> DataFrame:
        """(blob): those of the versions that the ledger lacks under these rules; the empty blob is known to hold nothing."""
        text = versions[content]
        blobs = versions.where(text.isNotNull() & (text != "")).select(blob_of(text).alias("blob")).distinct()
        return blobs.join(self.rows(rules).select("blob"), "blob", "left_anti")

    def update(self, versions: DataFrame, content: str = "content", rules: str = RULES_VERSION, scanner=find) -> int:
        """Scans what is unseen, appends it, and returns how many blobs that were."""

        def run(batches):
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            for batch in batches:
                found = [[dict(zip(("start", "kind", "end"), f, strict=True)) for f in scanner(t)] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["blob", "findings"])

        small_batches(self.spark)
        new = save(self.unseen(versions, content, rules), "unseen")
        n = new.count()
        if n:
            held = versions.select(blob_of(versions[content]).alias("blob"), versions[content].alias("content"))
            once = held.join(new, "blob", "left_semi").dropDuplicates(["blob"])
            scanned = once.mapInArrow(run, "blob binary, findings array<struct<start:int,kind:int,end:int>>")
            scanned.select("blob", F.lit(rules).alias("rules"), "findings").write.mode("append").parquet(self.path)
        return n

    def findings(self, versions: DataFrame, path: str = "path", content: str = "content", rules: str = RULES_VERSION) -> DataFrame:
        """Per version: its path, blob and findings from the ledger."""
        paths = versions.select(versions[path].alias("path"), blob_of(versions[content]).alias("blob"))
        # Most blobs hold nothing: only those that do need to meet their paths.
        known = self.rows(rules).where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])
        none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
        return paths.join(known, "blob", "left").select("path", "blob", F.coalesce("findings", none).alias("findings"))


def scan(versions: DataFrame, ledger: Ledger, path: str = "path", content: str = "content", rules: str = RULES_VERSION) -> DataFrame:
    """Brings the ledger up to date and returns the findings of all versions."""
    ledger.update(versions, content, rules)
    return ledger.findings(versions, path, content, rules)


def rendered(found: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, into: str = "doc_id") -> DataFrame:
    """Counts and span strings per version."""
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        F.col("path").alias(into), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(rendered(F.filter("findings", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), rendered(F.col("findings")).alias("spans"),
    )
