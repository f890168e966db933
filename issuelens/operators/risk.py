"""Risk scoring and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuelens.functions import risk as scores

RISK_COLUMNS = ("key", "project", "summary", "issue_type", "priority", "age_days", "status",
                "assignee", "risk_score")
SCORE_INPUTS = ("is_critical", "priority", "age_days", "is_resolved")


def _inputs():
    return [F.col(c) for c in SCORE_INPUTS]


def with_risk(df: DataFrame, digits: int | None = 3, name: str = "risk_score") -> DataFrame:
    return df.withColumn(name, scores.linear_risk(*_inputs(), digits=digits))


def with_fallback_risk(df: DataFrame, name: str = "overall_risk_score") -> DataFrame:
    return df.withColumn(name, scores.fallback_risk(*_inputs()))


def _ranking(score: str):
    return [F.col(score).desc_nulls_last(), F.col("created").desc_nulls_last(), F.col("key")]


def ranked(scored: DataFrame, score: str = "risk_score") -> DataFrame:
    """Highest scores first, newest first among equals."""
    return scored.orderBy(*_ranking(score))


def top_risks(scored: DataFrame, limit: int = 25, score: str = "risk_score") -> DataFrame:
    """The first rows of the ranking, by a per-task top-k."""
    return ranked(scored, score).limit(limit)


def top_risks_by(scored: DataFrame, by: Sequence[str], limit: int = 25,
                 score: str = "risk_score") -> DataFrame:
    """Top rows of each group. The rank filter is applied per map task before
    the shuffle, so a group of any size sends at most ``limit`` rows per task."""
    within = Window.partitionBy(*by).orderBy(*_ranking(score))
    return scored.withColumn("position", F.row_number().over(within)).where(
        F.col("position") <= limit)


def most_reopened(counts: DataFrame, limit: int = 3) -> DataFrame:
    return counts.orderBy(F.col("reopen_count").desc(), "key").limit(limit)
