"""How good scores are: accuracy, area under the curve, calibration.

All figures follow from counts per (score, label), so equal scores are one row
and nothing depends on the order of rows. The area is a rank sum; ranks come
from ranges of the score, with offsets from the ranges' totals, so no task
sorts all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuelens.functions.numbers import half_even, ratio
from issuelens.session import staged

#: Different scores that one range holds, about.
RANGE_SCORES = 1_000_000


def _counts(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per score; rows without score or label are left out."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label).cast("boolean")).alias("positives"),
        F.count_if(~F.col(label).cast("boolean")).alias("negatives"))


def area_under_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive scores above a negative, ties counting half; NULL where one kind is missing."""
    counts = staged(_counts(df, score, label, by), "score-counts")
    ranges = counts.count() // RANGE_SCORES + 1
    # ranges come from a sample, so they are written before anything refers to them
    dealt = staged(counts.repartitionByRange(ranges, *by, "score").withColumn("range", F.spark_partition_id()),
                   "score-ranges")
    totals = dealt.groupBy(*by, "range").agg(F.sum("negatives").alias("own"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*by, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("negatives").over(within), F.lit(0)))
    same = F.col("d.range") == F.col("o.range")
    for c in by:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}"))
    joined = placed.alias("d").join(offsets.alias("o"), same).select("d.*", "o.offset")
    # twice the number of negatives below, so that ties stay whole numbers
    twice = 2 * (F.col("offset") + F.col("inside")) + F.col("negatives")
    wide = F.col("positives").cast("decimal(20,0)")
    sums = joined.groupBy(*by).agg(
        F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"),
        F.sum((wide * twice.cast("decimal(18,0)")).cast("decimal(38,0)")).alias("twice"))
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double") * 2
    return sums.select(*by, "positives", "negatives", ratio(F.col("twice").cast("double"), pairs).alias("auc"))


def accuracy(df: DataFrame, score: str, label: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Share of rows on the right side of the threshold."""
    right = F.when(F.col("score") >= threshold, F.col("positives")).otherwise(F.col("negatives"))
    rows = F.sum(F.col("positives") + F.col("negatives"))
    return _counts(df, score, label, by).groupBy(*by).agg(
        F.coalesce(rows, F.lit(0)).alias("n"), ratio(F.sum(right), rows).alias("accuracy"))


def _bin(bins: int) -> Column:
    return F.least(F.greatest(F.floor(F.col("score") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def calibration(df: DataFrame, score: str, label: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Per bin of scores: rows, mean score and share of positives; empty bins are left out."""
    n = F.col("positives") + F.col("negatives")
    return _counts(df, score, label, by).groupBy(*by, _bin(bins).alias("bin")).agg(
        F.sum(n).alias("n"), half_even(ratio(F.sum(F.col("score") * n), F.sum(n)), 6).alias("mean_score"),
        half_even(ratio(F.sum("positives"), F.sum(n)), 6).alias("positive_share"))
