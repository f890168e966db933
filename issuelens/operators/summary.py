"""Headline counts and distributions.

Every operator is one hash aggregation. ``by`` adds grouping columns in front,
which turns "per release" into a key instead of a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuelens.functions.numbers import half_even, percentage, ratio
from issuelens.functions.status import LITERAL_RESOLVED, WEB_CLOSED, literal_in, open_definitions
from issuelens.functions.writeup import UNASSIGNED

# Priorities the web summary and the pattern summary single out.
WEB_CRITICAL_PRIORITIES = ("Critical", "Blocker")
PATTERN_HIGH = ("Highest", "High")
OLD_DAYS = 30


def comprehensive_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fifteen metrics. Over no rows counts are 0 and averages NULL."""
    resolved = F.col("is_resolved")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_defects"),
        F.count_distinct("project").alias("projects_affected"),
        F.count_if(~resolved).alias("open_defects"),
        F.count_if(resolved).alias("resolved_defects"),
        F.count_if("is_critical").alias("critical_defects"),
        F.count_if(F.col("is_critical") & ~resolved).alias("critical_open"),
        half_even(F.avg("age_days"), 1).alias("avg_age_days"),
        half_even(F.avg(F.when(~resolved, F.col("age_days"))), 1).alias("avg_age_open"),
        F.coalesce(F.max(F.when(~resolved, F.col("age_days"))), F.lit(0)).cast("bigint").alias(
            "oldest_open_defect_days"),
        percentage(resolved).alias("resolution_rate"),
        half_even(F.avg(F.when(resolved, F.col("resolution_time_hours"))), 1).alias(
            "avg_resolution_time_hours"),
        F.count_if(F.col("assignee") == UNASSIGNED).alias("unassigned_count"),
        percentage(F.col("assignee") == UNASSIGNED).alias("unassigned_rate"),
        F.count_if(F.col("priority") == "High").alias("high_priority_count"),
        F.count_if(~F.col("has_components")).alias("no_components_count"),
    )


def newest_value(df: DataFrame, column: str) -> Column:
    """Scalar: ``column`` of the newest row, found by a one-row top-k."""
    return (df.orderBy(F.col("created").desc_nulls_last(), "key").limit(1)
            .select(column).scalar())


def quick_summary(df: DataFrame, by: Sequence[str] = (),
                  newest: DataFrame | None = None) -> DataFrame:
    """Eight metrics; the current release is that of the newest row.

    ``newest`` may give the same rows through a narrower plan, holding just
    ``key, created, release_name``, for that lookup.
    """
    resolved = F.col("is_resolved")
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_defects"),
        F.count_distinct("project").alias("projects_affected"),
        F.count_if(~resolved).alias("open_defects"),
        half_even(F.avg("age_days"), 1).alias("avg_age_days"),
        half_even(F.avg(resolved.cast("int")) * 100, 1).alias("resolution_rate"),
        F.count_if("is_critical").alias("critical_count"),
        F.count_if(F.col("priority") == "High").alias("high_priority_count"),
    )
    if "release_name" in by:
        return out.withColumn("current_release", F.col("release_name"))
    current = newest_value(newest if newest is not None else df, "release_name")
    return out.withColumn("current_release", F.coalesce(current, F.lit("Unknown")))


def web_summary(df: DataFrame, releases: Sequence[str],
                critical_priorities: Sequence[str] = WEB_CRITICAL_PRIORITIES) -> DataFrame:
    """Counts over the requested releases; the rate is 0 when there are no rows."""
    closed = F.coalesce(literal_in(WEB_CLOSED)(F.col("status")), F.lit(False))
    rows = df.where(F.col("release_name").isin(list(releases)))
    return rows.agg(
        F.count(F.lit(1)).alias("total_defects"),
        F.count_if(closed).alias("resolved_defects"),
        F.coalesce(
            half_even(ratio(F.count_if(closed), F.count(F.lit(1))) * 100, 1), F.lit(0.0)
        ).alias("resolution_rate"),
        F.count_if(F.col("priority").isin(list(critical_priorities)) & ~closed).alias(
            "critical_open"),
        F.lit(", ".join(releases)).alias("releases"),
    )


def status_definitions(df: DataFrame, resolved_statuses: Sequence[str]) -> DataFrame:
    """Open count under each report's own idea of open, in one pass."""
    tests = open_definitions(resolved_statuses)
    counted = df.agg(*[F.count_if(test(F.col("status"))).alias(name)
                       for name, test in tests.items()])
    pairs = [x for name in tests for x in (F.lit(name), F.col(name))]
    return counted.select(F.stack(F.lit(len(tests)), *pairs).alias("definition", "open_count"))


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per value of each column, largest first; NULL is not a value."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))
        for c in columns
    ])
    return (
        df.select(*by, F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy(*by, "dimension", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*by, "dimension", F.col("n").desc(), "value")
    )


def value_counts_grouping_sets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same counts through GROUPING SETS over one joint pre-aggregate.

    For low-cardinality columns the expansion then runs on distinct
    combinations instead of on rows.
    """
    joint = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    grouped = joint.groupingSets([[c] for c in columns], *columns).agg(
        F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    last = len(columns) - 1
    dimension = value = F.lit(None).cast("string")
    for i, name in enumerate(columns):
        mask = 2 ** len(columns) - 1 - 2 ** (last - i)
        dimension = F.when(F.col("gid") == mask, name).otherwise(dimension)
        value = F.when(F.col("gid") == mask, F.col(name)).otherwise(value)
    return (
        grouped.select(dimension.alias("dimension"), value.alias("value"), "n")
        .where(F.col("value").isNotNull())
        .orderBy("dimension", F.col("n").desc(), "value")
    )


def severity_profile(df: DataFrame, column: str = "severity", unknown: str = "Unknown",
                     by: Sequence[str] = ()) -> DataFrame:
    """Distribution with the unknown count and the most common known value.

    The windows run over one row per severity value.
    """
    counts = (df.where(F.col(column).isNotNull()).groupBy(*by, column)
              .agg(F.count(F.lit(1)).alias("n")))
    known = F.col(column) != unknown
    everything = Window.partitionBy(*by).orderBy(
        known.desc(), F.col("n").desc(), column).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(column).over(everything)
    return counts.select(
        *by, column, "n",
        F.sum(F.when(known, 0).otherwise(F.col("n"))).over(everything).alias("unknown_count"),
        F.nullif(first, F.lit(unknown)).alias("most_common"),
    ).orderBy(*by, F.col("n").desc(), column)


def project_breakdown(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per project: size, open, critical, mean age, most frequent issue type.

    Counts per issue type come first, so the mode is a minimum over a few rows
    and no per-group value map is kept.
    """
    per_type = df.groupBy(*by, "project", "issue_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("is_resolved")).alias("open_n"),
        F.count_if("is_critical").alias("critical_n"),
        F.sum("age_days").alias("age_sum"),
        F.count("age_days").alias("age_n"),
    )
    typed = F.when(F.col("issue_type").isNotNull(), F.struct((-F.col("n")).alias("n"), "issue_type"))
    return per_type.groupBy(*by, "project").agg(
        F.sum("n").alias("total_defects"),
        F.sum("open_n").alias("open_defects"),
        F.sum("critical_n").alias("critical_defects"),
        ratio(F.sum("age_sum"), F.sum("age_n")).alias("avg_age"),
        F.coalesce(F.min(typed)["issue_type"], F.lit("N/A")).alias("top_issue_type"),
    ).orderBy(*by, "project")


def cross_project_insights(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Spread of the defects over projects, from one row per project."""
    per_project = df.where(F.col("project").isNotNull()).groupBy(*by, "project").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_critical").alias("critical_n"),
        F.count_if((F.col("age_days") > OLD_DAYS) & ~F.col("is_resolved")).alias("old_n"),
    )
    return per_project.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_projects_affected"),
        F.min(F.struct((-F.col("n")).alias("n"), "project"))["project"].alias(
            "most_affected_project"),
        F.count_if(F.col("critical_n") > 0).alias("projects_with_critical_bugs"),
        F.avg("n").alias("avg_defects_per_project"),
        F.count_if(F.col("old_n") > 0).alias("projects_with_old_bugs"),
    )


def critical_by_project(df: DataFrame) -> DataFrame:
    return (df.where("is_critical").groupBy("project")
            .agg(F.count(F.lit(1)).alias("critical_defects")).orderBy("project"))


def top_components(df: DataFrame, limit: int) -> DataFrame:
    """Most frequent components; rows without components contribute nothing."""
    return (
        df.select(F.explode("components").alias("component"))
        .where(F.col("component").isNotNull())
        .groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "component").limit(limit)
    )


def _listing(name: str, n: str) -> Column:
    """Aggregate: 'a: 3, b: 2' over a short aggregated frame, largest first."""
    entry = F.when(F.col(name).isNotNull(),
                   F.struct((-F.col(n)).alias("rank"), F.col(name).alias("name")))
    ordered = F.array_sort(F.collect_list(entry))
    return F.array_join(
        F.transform(ordered, lambda e: F.concat_ws(": ", e["name"], -e["rank"])), ", ")


def pattern_summary(df: DataFrame, limit: int = 5,
                    components: DataFrame | None = None) -> DataFrame:
    """One row of the facts a pattern review starts from.

    Everything but the components is summed per issue type first, so one pass
    gives both the totals and the type listing. ``components`` may give the
    component lists of the same rows through a narrower plan.
    """
    unresolved = F.coalesce(~literal_in(LITERAL_RESOLVED)(F.col("status")), F.lit(True))
    high = F.coalesce(F.col("priority").isin(list(PATTERN_HIGH)), F.lit(False))
    per_type = df.groupBy("issue_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(unresolved).alias("open_n"),
        F.count_if(high).alias("high_n"),
        F.sum(F.when(unresolved, F.col("age_days"))).alias("age_sum"),
        F.count(F.when(unresolved, F.col("age_days"))).alias("age_n"),
    )
    lists = components if components is not None else df
    common = top_components(lists, limit).agg(_listing("component", "n")).scalar()
    total, zero = F.sum("n"), F.lit(0).cast("bigint")
    return per_type.agg(
        F.coalesce(total, zero).alias("total_defects"),
        F.coalesce(F.sum("open_n"), zero).alias("open_defects"),
        half_even(ratio(F.sum("open_n"), total) * 100, 1).alias("open_percent"),
        F.coalesce(F.sum("high_n"), zero).alias("high_priority_defects"),
        half_even(ratio(F.sum("high_n"), total) * 100, 1).alias("high_priority_percent"),
        half_even(ratio(F.sum("age_sum"), F.sum("age_n")), 1).alias("avg_age_open"),
        _listing("issue_type", "n").alias("issue_types"),
    ).withColumn("top_components", common)


def group_comparison(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One wide row per group: summary, spread over projects, open ages.

    Sums per (group, project) come first; every metric of the group follows
    from them, so the rows are read and shuffled once.
    """
    is_open = ~F.col("is_resolved")
    open_age = F.when(is_open, F.col("age_days"))
    thresholds = (30, 14, 7)
    per_project = df.groupBy(*by, "project").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_open).alias("open_n"),
        F.count_if("is_critical").alias("critical_n"),
        F.count_if(F.col("priority") == "High").alias("high_n"),
        F.sum("age_days").alias("age_sum"), F.count("age_days").alias("age_n"),
        F.sum(open_age).alias("open_age_sum"), F.count(open_age).alias("open_age_n"),
        *[F.count_if(open_age > d).alias(f"over_{d}") for d in thresholds],
    )
    total = F.sum("n")
    named = F.when(F.col("project").isNotNull(), F.struct((-F.col("n")).alias("n"), "project"))
    return per_project.groupBy(*by).agg(
        total.alias("total_defects"),
        F.count("project").alias("projects_affected"),
        F.sum("open_n").alias("open_defects"),
        half_even(ratio(F.sum("age_sum"), F.sum("age_n")), 1).alias("avg_age_days"),
        half_even(ratio(total - F.sum("open_n"), total) * 100, 1).alias("resolution_rate"),
        F.sum("critical_n").alias("critical_count"),
        F.sum("high_n").alias("high_priority_count"),
        F.min(named)["project"].alias("most_affected_project"),
        F.count_if(F.col("project").isNotNull() & (F.col("critical_n") > 0)).alias(
            "projects_with_critical_bugs"),
        F.count_if(F.col("project").isNotNull() & (F.col(f"over_{OLD_DAYS}") > 0)).alias(
            "projects_with_old_bugs"),
        *[F.sum(f"over_{d}").alias(f"defects_over_{d}_days") for d in thresholds],
        half_even(ratio(F.sum("open_age_sum"), F.sum("open_age_n")), 1).alias("avg_age_open"),
    ).orderBy(*by)


def sample_rows(df: DataFrame, limit: int = 5, seed: int = 42) -> DataFrame:
    """A reproducible sample: the smallest digests of seed and key, which any database can compute."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), "key").limit(limit)
