"""Rule-based recommendations: one aggregate, then one row per rule that fires."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.functions.writeup import UNASSIGNED


# Message and action texts of the rules, whose wording is part of the result.
CRITICAL_OPEN = ("%d critical bugs are still open", "Immediately assign and prioritize critical bugs")
VERY_OLD = ("%d defects are older than 30 days", "Review and close/fix very old defects")
UNASSIGNED_OPEN = ("%d open defects are unassigned", "Assign ownership to open defects")
PROJECT_OPEN = ("Project %s has %d open defects", "Focus QA efforts on %s project")
HIGH_OPEN = ("%d high priority defects are still open", "Review and expedite high priority defects")
PROJECT_CRITICAL = ("Project '%s' has %d critical bugs", "Focus QA efforts on %s project")
AGING = ("%d defects across all projects are older than 14 days",
         "Review and prioritize old defects across all projects")
COMMON_SEVERITY = ("Most common severity value: %s (%d defects)", "Investigate pattern in severity = %s")


def _rule(kind: str, message: Column, action: Column | str, count: Column, threshold: int,
          position: int, **extra: str) -> Column:
    fields = [
        F.lit(position).alias("position"),
        F.lit(kind).alias("type"),
        message.alias("message"),
        (F.lit(action) if isinstance(action, str) else action).alias("action"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("count"),
        F.lit(threshold).alias("threshold"),
    ]
    return F.struct(*fields, *[F.lit(v).alias(k) for k, v in extra.items()])


def _fired(facts: DataFrame, rules: list[Column], by: Sequence[str] = ()) -> DataFrame:
    return (facts.select(*by, F.inline(F.array(*rules)))
            .where(F.col("count") > F.col("threshold"))
            .drop("threshold").orderBy(*by, "position"))


def _text(template: str, *values: str | Column) -> Column:
    return F.format_string(template, *values)


def _largest(count: str, name: str, among: Column | None = None) -> Column:
    """Name with the largest positive count, the smallest name among equals."""
    candidate = F.col(count) > 0
    if among is not None:
        candidate = among & candidate
    return F.min(F.when(candidate, F.struct((-F.col(count)).alias("n"), F.col(name).alias("name"))))


def comprehensive_recommendations(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Up to five rules (per group), in report order."""
    is_open = ~F.col("is_resolved")
    per_project = df.groupBy(*by, "project").agg(
        F.count_if(F.col("is_critical") & is_open).alias("critical_open"),
        F.count_if((F.col("age_days") > 30) & is_open).alias("very_old"),
        F.count_if((F.col("assignee") == UNASSIGNED) & is_open).alias("unassigned"),
        F.count_if(is_open).alias("open_n"),
        F.count_if((F.col("priority") == "High") & is_open).alias("high_open"),
    )
    facts = per_project.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("critical_open", "very_old", "unassigned", "high_open")],
        _largest("open_n", "project").alias("worst"),
    ).withColumns({"project": F.col("worst.name"), "project_open": -F.col("worst.n")})
    return _fired(facts, [
        _rule("critical_open", _text(CRITICAL_OPEN[0], "critical_open"),
              CRITICAL_OPEN[1], F.col("critical_open"), 0, 1,
              priority="Critical", impact="High"),
        _rule("very_old_defects", _text(VERY_OLD[0], "very_old"),
              VERY_OLD[1], F.col("very_old"), 0, 2,
              priority="High", impact="Medium"),
        _rule("unassigned_defects", _text(UNASSIGNED_OPEN[0], "unassigned"),
              UNASSIGNED_OPEN[1], F.col("unassigned"), 10, 3,
              priority="Medium", impact="Medium"),
        _rule("project_focus",
              _text(PROJECT_OPEN[0], "project", "project_open"),
              _text(PROJECT_OPEN[1], "project"), F.col("project_open"), 0, 4,
              priority="Medium", impact="Medium"),
        _rule("high_priority_open", _text(HIGH_OPEN[0], "high_open"),
              HIGH_OPEN[1], F.col("high_open"), 0, 5,
              priority="High", impact="High"),
    ], by)


def quick_recommendations(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Up to three rules, from one pass: counts per (project, severity) are
    rolled up to projects and to severities together."""
    is_open = ~F.col("is_resolved")
    sums = ("n", "critical_n", "old_open")
    joint = df.groupBy(*by, "project", "severity").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_critical").alias("critical_n"),
        F.count_if((F.col("age_days") > 14) & is_open).alias("old_open"),
    )
    rolled = joint.groupingSets(
        [[*by, "project"], [*by, "severity"]], *by, "project", "severity").agg(
        *[F.sum(c).alias(c) for c in sums], F.grouping("severity").alias("of_project"))
    of_project = F.col("of_project") == 1
    known = ~of_project & (F.col("severity") != "Unknown")
    facts = rolled.groupBy(*by).agg(
        F.sum(F.when(of_project, F.col("old_open"))).alias("old_open"),
        _largest("critical_n", "project", of_project).alias("worst"),
        _largest("n", "severity", known).alias("common"),
    ).select(
        *by, "old_open",
        F.col("worst.name").alias("project"), (-F.col("worst.n")).alias("critical_n"),
        F.col("common.name").alias("severity"), (-F.col("common.n")).alias("severity_n"),
    )
    return _fired(facts, [
        _rule("cross_project_critical",
              _text(PROJECT_CRITICAL[0], "project", "critical_n"),
              _text(PROJECT_CRITICAL[1], "project"), F.col("critical_n"), 0, 1),
        _rule("aging_defects",
              _text(AGING[0], "old_open"),
              AGING[1], F.col("old_open"), 0, 2),
        _rule("custom_field_pattern",
              _text(COMMON_SEVERITY[0], "severity", "severity_n"),
              _text(COMMON_SEVERITY[1], "severity"), F.col("severity_n"), 0, 3),
    ], by)
