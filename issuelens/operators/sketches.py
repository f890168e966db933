"""Percentiles from mergeable quantile sketches, kept in a table.

A sketch holds a bounded number of values of a group and answers any percentile
within a stated error of rank; sketches of parts merge into the sketch of the
whole. So resolution times are sketched once per release and week when they
arrive, and percentiles of a release, a quarter or everything are merged on
read, at the cost of the weeks, not of the issues. Values stay JVM-side (KLL).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.operators.health import PERCENTILES, timed

#: Values kept per sketch, which sets the error of rank.
K = 800


def rank_error(k: int = K) -> float:
    """Share of a group by which a percentile's rank may be off, in 99 of 100 cases."""
    return 2.296 / k**0.9021


def sketches(df: DataFrame, column: str, by: Sequence[str], k: int = K) -> DataFrame:
    """One row per group: ``by``, n and its sketch; NULL values are left out."""
    known = df.where(F.col(column).isNotNull())
    return known.groupBy(*by).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias("sketch"))


def resolution_sketches(df: DataFrame, by: Sequence[str] = ("release_name", "created_week"), k: int = K) -> DataFrame:
    return sketches(timed(df), "resolution_time_hours", by, k)


def merged(parts: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """Sketches of parts merged into those of coarser groups."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def _quantile(p: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(p))


def percentiles(parts: DataFrame, by: Sequence[str] = (), probabilities: dict[str, float] | None = None,
                k: int = K) -> DataFrame:
    """Percentiles per group from the sketches of its parts; a value that occurs, not an interpolated one."""
    whole = merged(parts, by, k).where("n > 0")
    return whole.select(*by, "n", *[
        _quantile(p).alias(name) for name, p in (probabilities or PERCENTILES).items()])


def rank_distances(df: DataFrame, column: str, estimates: DataFrame, by: Sequence[str] = (),
                   probabilities: dict[str, float] | None = None) -> DataFrame:
    """How far the rank of each estimate is from the one asked for, counted over all rows.

    ``estimates`` has ``by`` and a column per probability. The ranks of a value
    that occurs often are a range; the distance is that to the nearest of them.
    """
    wanted = probabilities or PERCENTILES
    named = F.explode(F.array(*[F.struct(
        F.lit(name).alias("name"), F.lit(p).alias("p"), F.col(name).alias("estimate"))
        for name, p in wanted.items()])).alias("of")
    asked = estimates.select(*[F.col(c).alias(f"_{c}") for c in by], named).select("*", "of.*").drop("of")
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    # rows per group: its different values times the few percentiles
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = counts.withColumn("_all", F.lit(1)).join(asked.withColumn("_all", F.lit(1)), "_all") if not by else counts.join(asked, same)
    below, up_to, total = (F.sum(F.when(when, F.col("_n")).otherwise(0)) for when in (
        F.col("_value") < F.col("estimate"), F.col("_value") <= F.col("estimate"), F.lit(True)))
    ranks = joined.groupBy(*by, "name", "p", "estimate").agg(
        total.alias("n"), (below / total).alias("from"), (up_to / total).alias("to"))
    return ranks.select(*by, "name", "p", "estimate", "n", F.greatest(
        F.col("from") - F.col("p"), F.col("p") - F.col("to"), F.lit(0.0)).alias("distance"))
