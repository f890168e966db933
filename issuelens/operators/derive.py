"""Columns computed from the stored ones; never stored, always from ``as_of``."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.config import AnalysisConfig
from issuelens.functions import dates
from issuelens.functions.numbers import half_even
from issuelens.functions.status import OPEN_LITERAL, StatusTest, finished, literal_in
from issuelens.functions.text import joined
from issuelens.functions.writeup import UNASSIGNED

# Defaults for missing fields.
FIELD_DEFAULTS = {
    "project": "Unknown",
    "project_name": "Unknown",
    "summary": "No summary",
    "description": "",
    "issue_type": "Unknown",
    "status": "Unknown",
    "priority": "Medium",
    "reporter": "Unknown",
    "assignee": UNASSIGNED,
    "severity": "Unknown",
}
ARRAY_FIELDS = ("components", "labels", "affected_versions", "fix_versions")


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill missing text fields with their defaults and missing lists with []."""
    present = set(df.columns)
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in FIELD_DEFAULTS.items() if c in present}
    filled |= {
        c: F.coalesce(F.col(c), F.array().cast("array<string>"))
        for c in ARRAY_FIELDS if c in present
    }
    return df.withColumns(filled) if filled else df


def with_derived(df: DataFrame, cfg: AnalysisConfig,
                 is_resolved: StatusTest | None = None,
                 hours_digits: int | None = 2,
                 only: Collection[str] | None = None) -> DataFrame:
    """Add every derived column whose inputs the frame has, or just ``only``.

    It is one lazy projection, so columns a query does not use are pruned
    together with the scans behind them.
    """
    is_resolved = is_resolved or finished(cfg.resolved_statuses)
    have = set(df.columns)
    rules = [
        ("is_resolved", {"status"}, lambda: is_resolved(F.col("status"))),
        ("is_open", {"status"},
         lambda: F.coalesce(literal_in(OPEN_LITERAL)(F.col("status")), F.lit(False))),
        ("is_critical", {"issue_type"},
         lambda: F.coalesce(F.col("issue_type").isin(list(cfg.critical_issue_types)), F.lit(False))
         if cfg.critical_issue_types else F.lit(False)),
        ("age_days", {"created"}, lambda: dates.age_days(F.col("created"), cfg.as_of)),
        ("resolution_time_hours", {"created", "resolved"}, lambda: _hours(hours_digits)),
        ("created_week", {"created"}, lambda: dates.week_key(F.col("created"))),
        ("created_month", {"created"}, lambda: dates.month_key(F.col("created"))),
        ("created_day", {"created"}, lambda: dates.day_key(F.col("created"))),
        ("summary_length", {"summary"}, lambda: F.length("summary").cast("bigint")),
        ("description_length", {"description"}, lambda: F.length("description").cast("bigint")),
        ("has_description", {"description"}, lambda: F.col("description") != ""),
        ("has_assignee", {"assignee"}, lambda: F.col("assignee") != UNASSIGNED),
        ("has_components", {"components"}, lambda: F.size("components") > 0),
        ("has_labels", {"labels"}, lambda: F.size("labels") > 0),
    ] + [(f"{c}_str", {c}, lambda c=c: joined(F.col(c))) for c in ARRAY_FIELDS]
    added = {
        name: make() for name, needs, make in rules
        if needs <= have and name not in have and (only is None or name in only)
    }
    return df.withColumns(added) if added else df


def _hours(digits: int | None):
    hours = dates.resolution_hours(F.col("created"), F.col("resolved"))
    return hours if digits is None else half_even(hours, digits)
