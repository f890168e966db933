"""Counts over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuelens.functions.dates import UNKNOWN_PERIOD
from issuelens.functions.numbers import half_even, share
from issuelens.operators.ranking import first_rows


def last_periods(grouped: DataFrame, column: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The latest ``n`` periods (of each group), newest first; rows without a date are no period."""
    return first_rows(grouped.where(F.col(column) != UNKNOWN_PERIOD), [F.col(column).desc()], n, by)


def undated_count(df: DataFrame) -> DataFrame:
    """Rows left out of every trend because their creation date is unknown."""
    return df.agg(F.count_if(F.col("created_day") == UNKNOWN_PERIOD).alias("undated"))


def weekly_trend(df: DataFrame, weeks: int = 12, by: Sequence[str] = ()) -> DataFrame:
    grouped = df.groupBy(*by, "created_week").agg(
        F.count("key").alias("created_count"),
        F.count_if("is_critical").alias("critical_count"),
    )
    return last_periods(grouped, "created_week", weeks, by)


def monthly_trend(df: DataFrame, months: int = 6, by: Sequence[str] = ()) -> DataFrame:
    grouped = df.groupBy(*by, "created_month").agg(
        F.count("key").alias("created_count"),
        half_even(share(F.col("is_resolved")), 3).alias("resolution_rate"),
    )
    return last_periods(grouped, "created_month", months, by)


def severity_trend(df: DataFrame, months: int = 6, by: Sequence[str] = ()) -> DataFrame:
    grouped = df.groupBy(*by, "created_month").agg(
        half_even(share(F.col("is_critical")), 3).alias("critical_rate"),
        half_even(share(F.col("priority") == "High"), 3).alias("high_priority_rate"),
    )
    return last_periods(grouped, "created_month", months, by)


def running_total(daily: DataFrame, by: Sequence[str] = ("release_name",)) -> DataFrame:
    """Running sum over one row per (release, day)."""
    so_far = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative_count", F.sum("daily_count").over(so_far))


def trendline(df: DataFrame, releases: Sequence[str] | None = None) -> DataFrame:
    """Daily discoveries per release and their running total, gaps not filled.

    Releases come in the order asked for, days ascending.
    """
    rows = df.where(F.col("created").isNotNull())
    order = ["release_name", "day"]
    if releases:
        rows = rows.where(F.col("release_name").isin(list(releases)))
        order.insert(0, F.array_position(F.array(*map(F.lit, releases)), F.col("release_name")))
    daily = rows.groupBy("release_name", F.col("created").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("daily_count"))
    return running_total(daily).orderBy(*order)
