"""Connected components of an edge table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id that an edge names; comp is the smallest id that can be reached.

    Each round takes the least label among the neighbours and then jumps to that label's
    own label, so long chains shrink fast. Every round is written to the shared folder.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = save(both.union(both.select("dst", "src")).distinct(), "edges")
    labels = save(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("id"), F.least("src", "low").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("comp").alias("low"))
        step = labels.join(near.withColumnRenamed("src", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        step = step.join(jump, "comp").select("id", "old", F.least("comp", "far").alias("comp"))
        step = save(step, "labels")
        labels = step.select("id", "comp")
        if step.where("comp <> old").isEmpty():
            return labels
