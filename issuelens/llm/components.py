"""Connected components by alternating stars.

Each round first hangs every node's larger neighbours on its least one, then
its smaller ones, so paths halve and end in stars around the least id. Rounds
are written to the shared folder, which cuts the lineage, and the one before is
removed; nothing but whether to go on reaches the driver. Hubs are pre-aggregated by the grouping
and split by the adaptive join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.session import discard, scratch_path, staged_at

#: Edges that one task handles with ease.
EDGES = 50_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    hung = up.join(least, "u").select(F.col("w").alias("u"), F.least("m", "u").alias("v"))
    return hung.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id of ``edges`` (a, b) but the least ones."""
    left, right = F.col("a").cast("long"), F.col("b").cast("long")
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    current = staged_at(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
                        .where("u <> v").distinct(), path)
    tasks = max(1, current.count() // EDGES)

    def sized(df: DataFrame) -> DataFrame:
        # as many tasks as the edges need; coalescing alone never adds any
        return df.coalesce(tasks)
    while True:
        # done when every id has one lesser neighbour, and that has none itself
        ends = current.select(F.col("v").alias("u")).distinct().withColumn("end", F.lit(True))
        lesser = current.groupBy("u").agg(F.count("*").alias("n"))
        if not sized(lesser.join(ends, "u", "left").where("n > 1 OR end")).count():
            break
        before, path = path, scratch_path(spark, "edges")
        current = staged_at(sized(_small_star(sized(_large_star(current)))), path)
        discard(spark, before)
    return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
