"""Queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace

    return replace(table(spark, sf_dir, "documents"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import materialise

    return materialise(table(spark, sf_dir, "documents"))


def op3_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the second one meets only known blobs and adds nothing."""
    from .secrets import Ledger, digest, scan

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    ledger.update(docs)
    return digest(scan(docs, ledger))


def op5_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    judged = assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_clean_words", "n_removed_lines")
    return judged.select("doc_id", *[F.col("quality")[n].alias(n) for n in names])


def op6_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("payload", "url")


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licenses

    return licenses(table(spark, sf_dir, "documents"))


def op10_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import digest, repeated_passages

    return digest(repeated_passages(table(spark, sf_dir, "documents")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import decoded, digest, encoded

    return digest(decoded(encoded(table(spark, sf_dir, "documents"))))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
