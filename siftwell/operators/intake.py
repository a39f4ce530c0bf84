"""Intake of a batch: what was measured, what was embedded, what is kept, and the two-pass selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..sources.tables import materialise
from .rank import rank, score, shortlist
from .select import best_photos

KEYS = ["session_id", "photo_id"]


def with_metrics(inputs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Every input with its metrics, or nulls, and whether it was analysed; upload_idx keeps the order."""
    return inputs.join(analyses.withColumn("analysed", F.lit(True)), KEYS, "left").withColumn("analysed", F.coalesce("analysed", F.lit(False)))


def split(photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analysed photos, and those that can't be."""
    return photos.where("analysed").drop("analysed"), photos.where("not analysed").drop("analysed")


def with_embeddings(photos: DataFrame, embedded: DataFrame) -> DataFrame:
    """Photos with the vectors (and errors) of those that were embedded; the others say so."""
    new = embedded.select(*KEYS, "embedding", F.col("error").alias("embed_error"))
    left = photos.drop("embedding").join(new, KEYS, "left")
    return left.withColumn("embed_error", F.when(F.col("embedding").isNull(), F.coalesce("embed_error", F.lit("Not embedded"))))


def with_sources(photos: DataFrame, originals: DataFrame, previews: DataFrame) -> DataFrame:
    """Adds what a photo can be shown from (its original, else its preview, else null) and whether it can be saved."""
    x = photos.join(originals.select(*KEYS, F.col("source").alias("original")), KEYS, "left").join(previews.select(*KEYS, F.col("source").alias("preview")), KEYS, "left")
    return x.withColumn("source", F.coalesce("original", "preview")).withColumn("saveable", F.col("original").isNotNull()).drop("original", "preview")


def merged(persisted: DataFrame, remembered: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two maps from keys to values; what is remembered wins."""
    values = [c for c in persisted.columns if c not in keys]
    right = remembered.select(*keys, F.lit(True).alias("newer"), *[F.col(c).alias(f"new_{c}") for c in values])
    pick = [F.when(F.col("newer"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return persisted.join(right, keys, "full").select(*keys, *pick)


def zipped(lists: DataFrame, keys: str, values: str, into: tuple[str, str] = ("key", "value")) -> DataFrame:
    """A row for each place of two lists that belong together."""
    rest = [c for c in lists.columns if c not in (keys, values)]
    return lists.select(*rest, F.explode(F.arrays_zip(F.col(keys).alias("k"), F.col(values).alias("v"))).alias("z")).select(*rest, F.col("z.k").alias(into[0]), F.col("z.v").alias(into[1]))


def uncollapsed(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """Ranked photos without those that stand behind a leader."""
    return ranked.join(groups.where("rank_in_group > 0").select(*KEYS), KEYS, "left_anti")


def kept(leaders: DataFrame, selected: DataFrame, unanalysed: DataFrame) -> DataFrame:
    """(session_id, photo_id) of what can still appear: leaders, the selection, and what was never measured."""
    return leaders.select(*KEYS).union(selected.select(*KEYS)).union(unanalysed.select(*KEYS)).distinct()


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose photo is among ids: what is stored of kept photos, their scores, a selection's scores."""
    return rows.join(ids.select(*KEYS), KEYS, "left_semi")


def files_to_embed(shortlisted: DataFrame, files: DataFrame) -> DataFrame:
    """The shortlisted photos whose file is at hand, with that file's columns."""
    return shortlisted.join(files, KEYS)


def two_pass_selection(photos: DataFrame, embedder: Callable[[DataFrame], DataFrame], weights: list[float], bias: float, p: Params = DEFAULT) -> DataFrame:
    """Selects by what is cheap, embeds the shortlist, and selects again where a session has more than one vector.

    photos lack the column embedding. embedder: (session_id, photo_id, ...) -> (session_id, photo_id, embedding, error),
    for example by ``pixel_arrays.embed``; it sees the shortlist only.
    """
    bare = photos.withColumn("embedding", F.lit(None).cast("array<double>"))
    ranked = rank(score(bare, p))
    embedded = materialise(embedder(shortlist(ranked, p).select(*photos.columns)).select(*KEYS, "embedding", "error"))
    enough = embedded.where("embedding is not null").groupBy("session_id").agg(F.count("*").alias("vectors")).where("vectors > 1").select("session_id")
    overlaid = with_embeddings(bare, embedded.join(enough, "session_id", "left_semi")).drop("embed_error")
    return best_photos(overlaid, weights, bias, p)

