"""Exact order statistics of sessions of any size, without sorting a session.

A session's values are counted by steps of its range (sums that tasks build first); the step that holds a wanted place
becomes the new range, as long as more than ``rows_per_task`` values lie in it. What is left is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise


def order_statistics(values: DataFrame, places: dict[str, Column], rows_per_task: int = 100_000, steps: int = 1024) -> DataFrame:
    """(session_id, n, one column for each place): the values at these places, counted from 0, of (session_id, x); places are Columns over n."""
    values = materialise(values.select("session_id", F.col("x").cast("double").alias("x")).where("x is not null"))
    sizes = values.groupBy("session_id").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in places.items()])).alias("w")
    open_ = materialise(sizes.select("session_id", "n", "lo", "hi", F.col("n").alias("inside"), each).select("session_id", "n", "w.*", "lo", "hi", "inside"))
    settled = None
    while True:
        wide = (F.col("inside") > rows_per_task) & (F.col("lo") < F.col("hi"))
        done = open_.where(~wide)
        settled = done if settled is None else settled.unionByName(done)
        if open_.where(wide).isEmpty():
            break
        span = F.col("hi") - F.col("lo")
        step = F.least(F.floor((F.col("x") - F.col("lo")) / span * steps), F.lit(steps - 1))
        counts = values.join(open_.where(wide), "session_id").where("x between lo and hi").groupBy("session_id", "name", "n", "place", step.alias("step")).agg(F.count("*").alias("inside"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("inside").over(Window.partitionBy("session_id", "name").orderBy("step"))
        held = counts.withColumn("before", upto - F.col("inside")).where("place >= before and place < before + inside")
        open_ = materialise(held.select("session_id", "n", "name", (F.col("place") - F.col("before")).alias("place"), "lo", "hi", "inside"))
    settled = materialise(settled)
    order = Window.partitionBy("session_id", "name").orderBy("x")
    sorted_ = values.join(settled.where("lo < hi"), "session_id").where("x between lo and hi").withColumn("i", F.row_number().over(order) - 1).where("i = place")
    found = sorted_.select("session_id", "name", "x").unionByName(settled.where("lo = hi").select("session_id", "name", F.col("lo").alias("x")))
    at = found.groupBy("session_id").agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in places])
    return sizes.select("session_id", "n").join(at, "session_id", "left")
