from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import QUICK_ROWS, RESOLVED_ROW
from issuelens.operators import health, recommend, report, risk, summary, trends
from issuelens.plans import analysis


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(df):
    [row] = df.collect()
    return row.asDict()


# The quick rows


def test_quick_summary(frame):
    got = one(summary.quick_summary(frame()))
    assert (got["total_defects"], got["projects_affected"], got["open_defects"],
            got["critical_count"], got["high_priority_count"]) == (6, 3, 3, 2, 2)
    assert got["resolution_rate"] == 50.0 and got["avg_age_days"] == 42.0
    assert got["current_release"] == "REL-31"


def test_quick_summary_of_nothing(frame):
    got = one(summary.quick_summary(frame([])))
    assert got["total_defects"] == 0 and got["current_release"] == "Unknown"
    assert got["avg_age_days"] is None and got["resolution_rate"] is None


def test_value_counts(frame):
    got = {(r["dimension"], r["value"]): r["n"]
           for r in summary.value_counts(frame(), ["priority", "issue_type"]).collect()}
    assert got == {("priority", "Highest"): 1, ("priority", "High"): 2, ("priority", "Medium"): 2,
                   ("priority", "Low"): 1, ("issue_type", "Bug"): 4, ("issue_type", "Critical Bug"): 2}
    sets = summary.value_counts_grouping_sets(frame(), ["priority", "issue_type"])
    assert {(r["dimension"], r["value"]): r["n"] for r in sets.collect()} == got


def test_value_counts_skip_nulls(frame):
    changed = frame().withColumn("priority", F.when(F.col("priority") != "High", F.col("priority")))
    for count in (summary.value_counts, summary.value_counts_grouping_sets):
        got = count(changed, ["priority", "severity"]).where("dimension = 'priority'").collect()
        assert {r["value"]: r["n"] for r in got} == {"Highest": 1, "Medium": 2, "Low": 1}


def test_severity_profile(frame):
    got = {r["severity"]: r for r in summary.severity_profile(frame()).collect()}
    assert got["Major"]["n"] == 3
    assert all(r["unknown_count"] == 1 and r["most_common"] == "Major" for r in got.values())


def test_all_unknown_severity_has_no_most_common(frame):
    [row] = summary.severity_profile(frame().withColumn("severity", F.lit("Unknown"))).collect()
    assert row["unknown_count"] == 6 and row["most_common"] is None


def test_project_breakdown(frame):
    got = {r["project"]: r for r in summary.project_breakdown(frame()).collect()}
    assert got["MAP"]["total_defects"] == 3 and got["MAP"]["open_defects"] == 1
    assert got["MAP"]["avg_age"] == 47.0 and got["MAP"]["top_issue_type"] == "Bug"
    assert got["PAY"]["top_issue_type"] == "Bug"  # a tie goes to the smaller name


def test_cross_project(frame):
    got = one(summary.cross_project_insights(frame()))
    assert got == {"total_projects_affected": 3, "most_affected_project": "MAP",
                   "projects_with_critical_bugs": 2, "avg_defects_per_project": 2.0,
                   "projects_with_old_bugs": 2}


def test_age_histogram(frame):
    got = rows(health.age_histogram(frame()).select("bucket", "n"))
    assert got == [("0-7 days", 1), ("8-14 days", 1), ("15-30 days", 1), ("31-60 days", 1),
                   ("61-90 days", 1), ("90+ days", 1)]


def test_age_histogram_edges(frame):
    ages = [-1, 0, 7, 8, 14, 15, 30, 31, 60, 61, 90, 91, 9999]
    made = frame([(f"K-{a}", "P", "s", "Bug", "Low", "Open", "S1", a, "x", "R") for a in ages])
    assert [n for _, _, n in rows(health.age_histogram(made))] == [2, 2, 2, 2, 2, 2]
    assert [n for _, _, n in rows(health.age_histogram(frame([])))] == [0] * 6


def test_oldest_open(frame):
    assert one(health.oldest_open(frame())) == {"key": "PAY-9", "age": 77, "project": "PAY"}
    resolved = frame([RESOLVED_ROW])
    assert one(health.oldest_open(resolved)) == {"key": None, "age": 0, "project": None}


def test_top_risks(frame):
    got = risk.top_risks(risk.with_risk(frame())).collect()
    assert got[0]["key"] == "PAY-9" and got[0]["risk_score"] == 1.0
    assert [r["risk_score"] for r in got] == sorted((r["risk_score"] for r in got), reverse=True)
    assert len(risk.top_risks(risk.with_risk(frame()), limit=2).collect()) == 2
    assert risk.top_risks(risk.with_risk(frame([]))).collect() == []


def test_open_scores_above_resolved(frame):
    row = ("A-1", "A", "s", "Bug", "Low", "Open", "S1", 10, "x", "R")
    made = frame([row, ("A-2", *row[1:5], "Resolved", *row[6:])])
    got = {r["key"]: r["risk_score"] for r in risk.with_risk(made).collect()}
    assert got["A-1"] > got["A-2"]


def test_age_cannot_outrank_a_critical(frame):
    made = frame([
        ("OLD", "A", "s", "Bug", "Low", "Open", "S1", 3650, "x", "R"),
        ("CRIT", "A", "s", "Critical Bug", "High", "Open", "S1", 30, "x", "R")])
    got = {r["key"]: r["risk_score"] for r in risk.with_risk(made).collect()}
    assert got["CRIT"] > got["OLD"]


def test_fallback_counts_highest(frame):
    made = frame([("A", "A", "s", "Bug", "Highest", "Open", "S1", 0, "x", "R")])
    assert risk.with_fallback_risk(made).first()["overall_risk_score"] == pytest.approx(0.4)
    assert risk.with_risk(made).first()["risk_score"] == pytest.approx(0.2)


def test_quick_recommendations(frame):
    got = recommend.quick_recommendations(frame()).collect()
    assert [(r["type"], r["count"]) for r in got] == [
        ("cross_project_critical", 1), ("aging_defects", 2), ("custom_field_pattern", 3)]
    assert got[0]["message"] == "Project 'API' has 1 critical bugs"  # a tie goes to the smaller name
    assert got[2]["action"] == "Investigate pattern in severity = Major"
    assert recommend.quick_recommendations(frame([])).collect() == []


def test_unassigned_rule_needs_more_than_ten(frame):
    def made(n):
        return frame([(f"K-{i}", "P", "s", "Bug", "Low", "Open", "S1", 1, "Unassigned", "R")
                      for i in range(n)])
    kinds = [r["type"] for r in recommend.comprehensive_recommendations(made(10)).collect()]
    assert kinds == ["project_focus"]
    kinds = [r["type"] for r in recommend.comprehensive_recommendations(made(11)).collect()]
    assert kinds == ["unassigned_defects", "project_focus"]


def test_nothing_to_recommend(frame):
    assert recommend.comprehensive_recommendations(frame([])).collect() == []
    assert recommend.comprehensive_recommendations(frame([RESOLVED_ROW])).collect() == []


# The comprehensive summary


UNKNOWN = ["resolution_rate", "avg_age_days", "avg_age_open", "unassigned_rate",
           "avg_resolution_time_hours"]


def test_empty_summary_is_unknown_not_zero(summary_frame):
    got = one(summary.comprehensive_summary(summary_frame()))
    assert all(got[m] is None for m in UNKNOWN)
    assert all(v == 0 for m, v in got.items() if m not in UNKNOWN)


def test_rates(summary_frame):
    got = one(summary.comprehensive_summary(summary_frame({}, {"is_resolved": False})))
    assert got["resolution_rate"] == 50.0
    got = one(summary.comprehensive_summary(summary_frame({"age_days": 3.0})))
    assert (got["resolution_rate"], got["avg_age_days"]) == (100.0, 3.0)
    five = one(summary.comprehensive_summary(summary_frame(*[{}] * 5)))
    assert five["resolution_rate"] == 100.0
    got = one(summary.comprehensive_summary(summary_frame(
        {"assignee": "Unassigned"}, {}, {}, {"assignee": "Unassigned"})))
    assert (got["unassigned_rate"], got["unassigned_count"]) == (50.0, 2)


def test_open_rows_have_no_resolution_time(summary_frame):
    got = one(summary.comprehensive_summary(summary_frame(
        {"resolution_time_hours": 10.0}, {"is_resolved": False, "resolution_time_hours": None})))
    assert got["avg_resolution_time_hours"] == 10.0


# Health, percentiles, SLA


def test_project_without_open_work_has_no_age_penalty(summary_frame):
    made = summary_frame({"age_days": 500.0}, {"age_days": 900.0, "is_critical": True}).withColumn(
        "key", F.lit("K"))
    got = one(health.project_health(made))
    assert got["avg_age_open_days"] == 0.0
    assert got["health_score"] == pytest.approx(0.4 + 0.5 * 0.3 + 0.3)


@pytest.mark.parametrize("n, seed", [(1, 1), (2, 2), (37, 3), (500, 4)])
def test_percentiles_match_numpy(spark, n, seed):
    rng = random.Random(seed)
    values = [round(rng.choice([rng.uniform(-50, 50), rng.expovariate(1 / 200), 24.0]), 2)
              for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wanted = {"p0": 0.0, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p100": 1.0}
    got = one(health.exact_percentiles(df, "v", wanted))
    for name, p in wanted.items():
        assert got[name] == pytest.approx(float(np.quantile(values, p)), abs=1e-9)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "is_resolved boolean, resolution_time_hours double")
    assert health.resolution_percentiles(df).collect() == []


def test_sla(spark):
    df = spark.createDataFrame(
        [(True, True, 48.0), (True, True, 48.1), (True, False, 168.0), (False, True, 1.0),
         (True, True, None)], "is_resolved boolean, is_critical boolean, resolution_time_hours double")
    assert one(health.sla_compliance(df)) == {"critical_under_48h": 50.0, "normal_under_168h": 100.0}
    assert one(health.sla_compliance(df.limit(0))) == {
        "critical_under_48h": 0.0, "normal_under_168h": 0.0}


def test_thresholds_are_strict(frame):
    made = frame([(f"K-{a}", "P", "s", "Bug", "Low", "Open", "S1", a, "x", "R")
                  for a in (7, 8, 14, 15, 30, 31)])
    got = one(health.aging_thresholds(made))
    assert (got["total_open"], got["defects_over_30_days"], got["defects_over_14_days"],
            got["defects_over_7_days"]) == (6, 1, 3, 5)


def test_workload_leaves_out_unassigned(frame):
    made = frame([*QUICK_ROWS, ("X-1", "X", "s", "Bug", "Low", "Open", "S1", 1, "Unassigned", "R")])
    made = made.withColumn("resolution_time_hours", F.lit(None).cast("double"))
    got = rows(health.assignee_workload(made).select("assignee", "open_count"))
    assert got == [("noor", 2), ("ivo", 0), ("mei", 0)]


def test_components_ignore_empty_and_null(spark):
    df = spark.createDataFrame(
        [("A", False, True, 4, ["x", "y"]), ("B", True, False, 8, ["x", None]),
         ("C", False, False, 1, []), ("D", False, False, 1, None)],
        "key string, is_resolved boolean, is_critical boolean, age_days bigint, "
        "components array<string>")
    assert rows(health.component_stats(df)) == [("x", 2, 1, 1, 6.0), ("y", 1, 1, 1, 4.0)]
    assert rows(health.component_stats(df.where("key > 'B'"))) == []


# Trends


def test_undated_rows_take_no_period(frame):
    made = frame().withColumn("created_week", F.when(F.col("key") == "PAY-7", "Unknown").otherwise(
        F.col("created_week")))
    got = trends.weekly_trend(made, weeks=2).collect()
    assert len(got) == 2 and all(r["created_week"] != "Unknown" for r in got)


def test_trendline_keeps_gaps_and_request_order(spark):
    df = spark.sql("""
        SELECT * FROM VALUES ('A', timestamp_ntz'2026-01-01 10:00:00'),
          ('A', timestamp_ntz'2026-01-01 23:00:00'), ('A', timestamp_ntz'2026-01-05 00:00:00'),
          ('B', timestamp_ntz'2026-01-02 00:00:00'), ('B', CAST(NULL AS timestamp_ntz)),
          ('C', timestamp_ntz'2026-01-02 00:00:00') AS t(release_name, created)""")
    got = [(r["release_name"], str(r["day"]), r["daily_count"], r["cumulative_count"])
           for r in trends.trendline(df, ["B", "A"]).collect()]
    assert got == [("B", "2026-01-02", 1, 1), ("A", "2026-01-01", 2, 2), ("A", "2026-01-05", 1, 3)]


# Whole analyses


def test_quick_analysis_sections(frame):
    base = frame().withColumn("created_week", F.lit("w"))
    parts = analysis.quick_analysis(base)
    assert set(parts) == {"summary", "project_breakdown", "priorities", "issue_types",
                          "custom_field", "aging", "oldest_open_defect",
                          "cross_project_insights", "top_risks", "recommendations"}
    for part in parts.values():
        assert part.collect()


def _full(spark, cfg):
    rng = random.Random(5)
    data = [(f"K-{i}", rng.choice("PQ"), f"summary {i}", "text", rng.choice(["Bug", "Critical Bug"]),
             rng.choice(["Open", "Done"]), rng.choice(["High", "Low"]), "rep",
             rng.choice(["ann", "Unassigned"]), "S1", f"2026-0{rng.randint(1, 5)}-10 00:00:00",
             "2026-05-30 00:00:00", ["api"], f"REL-2{rng.randint(3, 5)}") for i in range(60)]
    df = spark.createDataFrame(
        data, "key string, project string, summary string, description string, issue_type string, "
        "status string, priority string, reporter string, assignee string, severity string, "
        "c string, r string, components array<string>, release_name string")
    return df.select("*", F.col("c").cast("timestamp_ntz").alias("created"),
                     F.when(F.col("status") == "Done", F.col("r")).cast("timestamp_ntz").alias(
                         "resolved"))


def test_comprehensive_analysis_and_report(spark, cfg):
    base = analysis.analysis_base(_full(spark, cfg), cfg).cache()
    parts = analysis.comprehensive_analysis(base, cfg)
    assert len(parts) == 22
    for name, part in parts.items():
        assert part.collect() or name == "undated", name
    long = analysis.full_report(base, cfg).collect()
    assert [r["section"] for r in long][0] == "summary"
    assert sum(r["section"] == "summary" for r in long) == 15
    assert sum(r["section"] == "risks" for r in long) == 15 * 7
    order = [(r["section_no"], r["item_no"], r["metric_no"]) for r in long]
    assert order == sorted(order)
    base.unpersist()


def test_compare_releases(spark, cfg):
    base = analysis.analysis_base(_full(spark, cfg), cfg)
    parts = analysis.compare_releases(base, cfg, "REL-25", previous=1)
    got = {r["release_name"]: r["total_defects"] for r in parts["summary"].collect()}
    expected = {r["release_name"]: r["count"]
                for r in base.where("release_name > 'REL-23'").groupBy("release_name").count().collect()}
    assert got == expected
    assert {r["current_release"] for r in parts["summary"].collect()} == set(expected)
    with pytest.raises(ValueError, match="No release"):
        analysis.compare_releases(base, cfg)


def test_preview_is_newest_first(frame):
    got = [r["key"] for r in report.preview(frame(), 2).collect()]
    assert got == ["PAY-7", "MAP-4"]


def test_a_frame_with_only_keys_has_empty_sections(spark, cfg):
    base = analysis.analysis_base(spark.createDataFrame([("A-1",)], "key string"), cfg)
    parts = analysis.comprehensive_analysis(base, cfg)
    assert one(parts["summary"])["total_defects"] == 1
    assert one(parts["undated"]) == {"undated": 1}
    for name in ("weekly_trend", "component_analysis", "resolution_time_percentiles",
                 "top_critical_components", "assignee_analysis"):
        assert parts[name].collect() == [], name


def test_sections_per_release_equal_the_sections_of_each_release(spark, cfg):
    base = analysis.analysis_base(_full(spark, cfg), cfg).cache()
    parts = analysis.sections_by_release(base)
    alone = {
        "project_breakdown": summary.project_breakdown,
        "custom_field": summary.severity_profile,
        "aging": health.age_histogram,
        "aging_thresholds": health.aging_thresholds,
        "oldest_open_defect": health.oldest_open,
        "cross_project_insights": summary.cross_project_insights,
        "recommendations": recommend.quick_recommendations,
    }
    for release in ("REL-23", "REL-24", "REL-25"):
        rows_of = base.where(F.col("release_name") == release)
        for name, section in alone.items():
            got = parts[name].where(F.col("release_name") == release).drop("release_name")
            assert rows(got) == rows(section(rows_of)), (release, name)
    base.unpersist()
