"""The written report as rows: section, item, metric, value, in report order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuelens.functions.text import shorten

PROJECTS_SHOWN = 10
RISKS_SHOWN = 15
SUMMARY_WIDTH = 60


def _section(df: DataFrame, section: str, number: int, item: Column | str, position: Column,
             metrics: Sequence[str | tuple[str, Column]]) -> DataFrame:
    named = [(m, F.col(m)) if isinstance(m, str) else m for m in metrics]
    rows = F.array(*[
        F.struct(F.lit(i).alias("metric_no"), F.lit(name).alias("metric"),
                 value.cast("string").alias("value"))
        for i, (name, value) in enumerate(named)
    ])
    item = F.lit(item) if isinstance(item, str) else item
    # Positions are fixed before the metrics of an item become rows.
    items = df.select(
        F.lit(number).alias("section_no"), F.lit(section).alias("section"),
        position.cast("bigint").alias("item_no"), item.alias("item"), rows.alias("metrics"))
    return items.select("section_no", "section", "item_no", "item", F.inline("metrics"))


def _numbered(*order: Column | str) -> Column:
    """Row numbers over a frame already cut to report length."""
    return F.row_number().over(Window.orderBy(*order))


def report_long(summary: DataFrame, health: DataFrame, recommendations: DataFrame,
                risks: DataFrame) -> DataFrame:
    """All summary metrics, the first ten projects, every recommendation and
    the first fifteen risks.

    ``health`` and ``risks`` are cut by top-k before they are numbered.
    """
    worst = health.orderBy("health_score", "project").limit(PROJECTS_SHOWN)
    listed = risks.orderBy(F.col("risk_score").desc(), F.col("created").desc(), "key").limit(
        RISKS_SHOWN)
    parts = [
        _section(summary, "summary", 1, "all", F.lit(1), summary.columns),
        _section(worst, "projects", 2, F.col("project"),
                 _numbered("health_score", "project"),
                 ["total_defects", "open_defects", "health_score"]),
        _section(recommendations, "recommendations", 3, F.col("type"), F.col("position"),
                 ["priority", "message", "action", "impact", "count"]),
        _section(listed, "risks", 4, F.col("key"),
                 _numbered(F.col("risk_score").desc(), F.col("created").desc(), "key"),
                 ["project", "risk_score",
                  ("summary", shorten(F.col("summary"), SUMMARY_WIDTH, always=True)),
                  "issue_type", "priority", "age_days", "assignee"]),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.orderBy("section_no", "item_no", "metric_no")


def preview(df: DataFrame, limit: int = 100) -> DataFrame:
    """The newest rows."""
    return df.orderBy(F.col("created").desc_nulls_last(), "key").limit(limit)
