"""The analyses a user runs: each is a dict of lazy frames over one base."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from issuelens.config import AnalysisConfig
from issuelens.operators import health, ml, recommend, releases, report, risk, summary, trends
from issuelens.operators.derive import with_defaults, with_derived
from issuelens.operators.risk import RISK_COLUMNS
from issuelens.schema import with_missing
from issuelens.sources.store import DefectStore

VALUE_COLUMNS = ("project", "priority", "issue_type", "severity", "release_name")
BASE_COLUMNS = ("key", "project", "summary", "issue_type", "priority", "status", "assignee",
                "reporter", "severity", "release_name", "created", "components", "age_days",
                "is_resolved", "is_critical", "resolution_time_hours", "has_components",
                "created_week", "created_month", "created_day", "summary_length",
                "description_length")


def analysis_base(defects: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """The narrow frame all sections share. Persist or stage it when running
    many of them; descriptions, changelogs and raw JSON are not part of it.

    A column the source lacks is NULL, so its sections come out empty instead
    of failing.
    """
    rows = with_derived(with_defaults(with_missing(defects)), cfg)
    return rows.select(*BASE_COLUMNS)


def comprehensive_analysis(base: DataFrame, cfg: AnalysisConfig, learned: bool = False,
                           **model_settings) -> dict[str, DataFrame]:
    """All sections of the full report.

    With ``learned`` the risk ranking comes from models trained on ``base``;
    training runs at once, everything else stays lazy.
    """
    if learned:
        scored = ml.score_risks(base, cfg, **model_settings)
        ranked = risk.top_risks(scored, score="overall_risk_score").withColumnRenamed(
            "overall_risk_score", "risk_score")
    else:
        ranked = risk.top_risks(risk.with_risk(base, digits=None))
    return {
        "summary": summary.comprehensive_summary(base),
        "project_analysis": health.project_health(base),
        "issue_type_distribution": summary.value_counts(base, ["issue_type"]),
        "priority_distribution": summary.value_counts(base, ["priority"]),
        "critical_by_project": summary.critical_by_project(base),
        "top_critical_components": summary.top_components(base.where("is_critical"), 10),
        "severity_trend": trends.severity_trend(base),
        "age_distribution": health.age_histogram(base),
        "project_aging": health.aging_by_project(base),
        "priority_aging": health.aging_by(base, "priority"),
        "issue_type_aging": health.aging_by(base, "issue_type"),
        "oldest_open_defect": health.oldest_open(base),
        "aging_thresholds": health.aging_thresholds(base),
        "weekly_trend": trends.weekly_trend(base),
        "monthly_trend": trends.monthly_trend(base),
        "undated": trends.undated_count(base),
        "assignee_analysis": health.assignee_workload(base),
        "component_analysis": health.component_stats(base),
        "resolution_time_percentiles": health.resolution_percentiles(base),
        "sla_compliance": health.sla_compliance(base),
        "top_risks": ranked.select(*RISK_COLUMNS, "created"),
        "recommendations": recommend.comprehensive_recommendations(base),
    }


def quick_analysis(base: DataFrame) -> dict[str, DataFrame]:
    """The short report."""
    return {
        "summary": summary.quick_summary(base),
        "project_breakdown": summary.project_breakdown(base),
        "priorities": summary.value_counts(base, ["priority"]),
        "issue_types": summary.value_counts(base, ["issue_type"]),
        "custom_field": summary.severity_profile(base),
        "aging": health.age_histogram(base),
        "oldest_open_defect": health.oldest_open(base),
        "cross_project_insights": summary.cross_project_insights(base),
        "top_risks": risk.top_risks(risk.with_risk(base)).select(*RISK_COLUMNS),
        "recommendations": recommend.quick_recommendations(base),
    }


def full_sections_by_release(base: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """What the full report adds to the short one, per release."""
    return {
        "project_analysis": health.project_health(base, by),
        "severity_trend": trends.severity_trend(base, by=by),
        "weekly_trend": trends.weekly_trend(base, by=by),
        "monthly_trend": trends.monthly_trend(base, by=by),
        "project_aging": health.aging_by_project(base, by),
        "priority_aging": health.aging_by(base, "priority", by),
        "issue_type_aging": health.aging_by(base, "issue_type", by),
        "assignee_analysis": health.assignee_workload(base, by=by),
        "component_analysis": health.component_stats(base, by=by),
        "resolution_time_percentiles": health.resolution_percentiles(base, by=by),
        "sla_compliance": health.sla_compliance(base, by),
        "full_recommendations": recommend.comprehensive_recommendations(base, by),
    }


def sections_by_release(base: DataFrame) -> dict[str, DataFrame]:
    """The reports per release: the release is one more grouping key."""
    by = ["release_name"]
    return {
        **full_sections_by_release(base, by),
        "summary": summary.quick_summary(base, by),
        "project_breakdown": summary.project_breakdown(base, by),
        "distributions": summary.value_counts(base, ["priority", "issue_type", "severity"], by),
        "custom_field": summary.severity_profile(base, by=by),
        "aging": health.age_histogram(base, by),
        "aging_thresholds": health.aging_thresholds(base, by),
        "oldest_open_defect": health.oldest_open_by(base, by),
        "cross_project_insights": summary.cross_project_insights(base, by),
        "top_risks": risk.top_risks_by(risk.with_risk(base), by).select(
            "release_name", "position", *RISK_COLUMNS),
        "recommendations": recommend.quick_recommendations(base, by),
    }


def compare_releases(base: DataFrame, cfg: AnalysisConfig, current: str | None = None,
                     previous: int = 2) -> dict[str, DataFrame]:
    """The current release beside the ones before it."""
    current = current or cfg.current_release
    if not current:
        raise ValueError("No release specified: pass one or set current_release.")
    spark = base.sparkSession
    wanted = releases.sequence_rows(
        spark.createDataFrame([(current,)], "current string"), "current", previous + 1,
        cfg.releases_per_year)
    return sections_by_release(releases.in_releases(base, wanted))


def release_comparison(base: DataFrame) -> DataFrame:
    """One wide row per release."""
    return summary.group_comparison(base, ["release_name"])


def store_analysis(base: DataFrame, store: DefectStore, at: datetime | None = None) -> None:
    """Append every release's own sections to the result table."""
    for name, frame in sections_by_release(base).items():
        store.store_results(frame, name, at)


def full_report(base: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """The written report in long form."""
    parts = comprehensive_analysis(base, cfg)
    return report.report_long(parts["summary"], parts["project_analysis"],
                              parts["recommendations"], parts["top_risks"])


def store_trendline(store: DefectStore, cfg: AnalysisConfig,
                    wanted: Sequence[str] | None = None) -> DataFrame:
    """Daily discoveries of stored releases, the configured ones by default."""
    names = list(wanted or cfg.default_releases)
    return trends.trendline(store.get_defects(names), names)
