"""Project health, ageing, workload and resolution performance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuelens.functions.numbers import band, clip01, half_even, ratio, share
from issuelens.functions.risk import HEALTH_BANDS
from issuelens.functions.writeup import UNASSIGNED
from issuelens.operators.ranking import first_rows

# Inclusive age buckets, SLA hours, percentiles.
AGE_BUCKETS = (
    ("0-7 days", 0, 7),
    ("8-14 days", 8, 14),
    ("15-30 days", 15, 30),
    ("31-60 days", 31, 60),
    ("61-90 days", 61, 90),
    ("90+ days", 91, None),
)
CRITICAL_SLA_HOURS = 48
NORMAL_SLA_HOURS = 168
PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def _is_open() -> Column:
    return ~F.col("is_resolved")


def project_health(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per project: counts, averages and the weighted health score, worst first.

    The age term uses open issues only, on their rounded average; a project
    with nothing open has no age penalty.
    """
    stats = df.groupBy(*by, "project").agg(
        F.count("key").alias("total_defects"),
        F.count_if(_is_open()).alias("open_defects"),
        F.count_if("is_critical").alias("critical_defects"),
        half_even(F.avg("age_days"), 2).alias("avg_age_days"),
        F.count_if(F.col("priority") == "High").alias("high_priority_count"),
        F.count_if(F.col("assignee") == UNASSIGNED).alias("unassigned_count"),
        half_even(F.avg("resolution_time_hours"), 2).alias("avg_resolution_hours"),
        F.coalesce(half_even(F.avg(F.when(_is_open(), F.col("age_days"))), 2), F.lit(0.0)).alias(
            "avg_age_open_days"),
    )
    score = (
        (1 - ratio(F.col("open_defects"), F.col("total_defects"))) * 0.4
        + (1 - ratio(F.col("critical_defects"), F.col("total_defects"))) * 0.3
        + (1 - clip01(F.col("avg_age_open_days") / 30)) * 0.3
    )
    return (stats.withColumn("health_score", half_even(score, 3))
            .orderBy(*by, "health_score", "project"))


def healthiest(health: DataFrame, limit: int = 5) -> DataFrame:
    return health.orderBy(F.col("health_score").desc(), "project").limit(limit)


def health_bands(health: DataFrame) -> DataFrame:
    """Band names are those of the risk: a healthy project is a low risk."""
    high, medium = HEALTH_BANDS
    named = band(F.col("health_score"), high, medium, ("low", "medium", "high"))
    return health.select("project", "health_score", named.alias("risk_band"))


def age_histogram(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All six buckets, empty ones as 0; one pass, then six rows unpivoted."""
    age = F.col("age_days")
    counts = [
        F.count_if((age >= low) & (age <= high) if high is not None else age >= low).alias(name)
        for name, low, high in AGE_BUCKETS
    ]
    cells = [x for i, (name, _, _) in enumerate(AGE_BUCKETS)
             for x in (F.lit(i + 1), F.lit(name), F.col(f"`{name}`"))]
    return (df.groupBy(*by).agg(*counts)
            .select(*by, F.stack(F.lit(len(AGE_BUCKETS)), *cells).alias("position", "bucket", "n"))
            .orderBy(*by, "position"))


def aging_by_project(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        df.where(_is_open()).groupBy(*by, "project").agg(
            half_even(F.avg("age_days"), 1).alias("avg_age"),
            F.max("age_days").alias("oldest_defect"),
            F.count("age_days").alias("open_count"),
        ).orderBy(*by, F.col("avg_age").desc(), "project")
    )


def aging_by(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean age and the fraction still open per value of ``column``."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(
            half_even(F.avg("age_days"), 3).alias("avg_age_days"),
            half_even(share(_is_open()), 3).alias("percent_open"),
        ).orderBy(*by, column)
    )


def _oldest_first() -> list[Column]:
    return [F.col("age_days").desc_nulls_last(), F.col("created").desc_nulls_last(), F.col("key")]


def oldest_open(df: DataFrame) -> DataFrame:
    """The oldest open issue, newest-first order breaking ties; always one row."""
    top = df.where(_is_open()).orderBy(*_oldest_first()).limit(1)
    return top.agg(
        F.first("key").alias("key"),
        F.coalesce(F.first("age_days"), F.lit(0)).cast("bigint").alias("age"),
        F.first("project").alias("project"),
    )


def oldest_open_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The oldest open issue of each group that has one."""
    within = Window.partitionBy(*by).orderBy(*_oldest_first())
    ranked = df.where(_is_open()).withColumn("_rank", F.row_number().over(within))
    return ranked.where("_rank = 1").select(
        *by, "key", F.col("age_days").alias("age"), "project").orderBy(*by)


def aging_thresholds(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    def older(days: int) -> Column:
        return F.count_if(_is_open() & (F.col("age_days") > days)).alias(
            f"defects_over_{days}_days")

    return df.groupBy(*by).agg(
        F.count_if(_is_open()).alias("total_open"),
        older(30), older(14), older(7),
        half_even(F.avg(F.when(_is_open(), F.col("age_days"))), 1).alias("avg_age_open"),
    )


def assignee_workload(df: DataFrame, limit: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Busiest people. The 'Unassigned' rows, often the hottest key, leave
    before the shuffle."""
    people = df.where(F.col("assignee") != UNASSIGNED).groupBy(*by, "assignee").agg(
        F.count("key").alias("total_assigned"),
        F.count_if(_is_open()).alias("open_count"),
        F.count_if("is_critical").alias("critical_count"),
        half_even(F.avg("age_days"), 2).alias("avg_age"),
        half_even(F.avg("resolution_time_hours"), 2).alias("avg_resolution_hours"),
    )
    return first_rows(people, [F.col("open_count").desc(), F.col("assignee")], limit, by)


def component_stats(df: DataFrame, limit: int = 15, by: Sequence[str] = ()) -> DataFrame:
    parts = (
        df.select(*by, "key", "is_resolved", "is_critical", "age_days",
                  F.explode("components").alias("component"))
        .where(F.col("component").isNotNull())
        .groupBy(*by, "component").agg(
            F.count("key").alias("total_defects"),
            F.count_if(_is_open()).alias("open_count"),
            F.count_if("is_critical").alias("critical_count"),
            half_even(F.avg("age_days"), 2).alias("avg_age"),
        )
    )
    return first_rows(parts, [F.col("open_count").desc(), F.col("component")], limit, by)


def timed(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_resolved") & F.col("resolution_time_hours").isNotNull())


def resolution_percentiles(df: DataFrame, probabilities: dict[str, float] | None = None,
                           by: Sequence[str] = ()) -> DataFrame:
    """Interpolated percentiles of the resolution time; no row when none is known."""
    return exact_percentiles(timed(df), "resolution_time_hours", probabilities or PERCENTILES, 1, by)


def exact_percentiles(df: DataFrame, column: str, probabilities: dict[str, float],
                      digits: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles (of each group) without gathering the values in one task.

    Values are counted once, the counts are summed into unit-wide cells, and
    the running total over cells (one row per whole unit of the span) tells
    which cells hold the wanted ranks; only those cells are looked into. The
    running total of a group is one task's work, so this suits values whose
    span is small in units, such as hours, and not any numbers.
    """
    counts = df.groupBy(*by, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy(*by, F.floor("v").alias("cell")).agg(F.sum("n").alias("cell_n"))
    up_to = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    group = {c: f"_of_{c}" for c in by}
    placed = cells.select(
        *[F.col(c).alias(group[c]) for c in by], "cell", "cell_n",
        F.coalesce(F.sum("cell_n").over(up_to), F.lit(0)).alias("before"),
        F.sum("cell_n").over(everything).alias("total"),
    )

    def position(p: float) -> Column:
        return F.lit(p) * (F.col("total") - 1)

    def holds(rank: Column, start: Column, n: Column) -> Column:
        return (start <= rank) & (rank < start + n)

    wanted = F.lit(False)
    for p in probabilities.values():
        for edge in (F.floor(position(p)), F.ceil(position(p))):
            wanted = wanted | holds(edge, F.col("before"), F.col("cell_n"))
    held = placed.where(wanted)
    if not by:
        # At most two cells per percentile, so this side is safe to broadcast.
        held = F.broadcast(held)
    same = F.floor("v") == F.col("cell")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(group[c]))
    fine = counts.join(held, same)
    inside = Window.partitionBy(*by, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = fine.withColumn(
        "start", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))

    found = []
    for name, p in probabilities.items():
        at = position(p)
        low, high = F.floor(at), F.ceil(at)
        below = F.max(F.when(holds(low, F.col("start"), F.col("n")), F.col("v")))
        above = F.max(F.when(holds(high, F.col("start"), F.col("n")), F.col("v")))
        value = below + (above - below) * F.max(at - low)
        found.append((value if digits is None else half_even(value, digits)).alias(name))
    return ranked.groupBy(*by).agg(*found, F.count(F.lit(1)).alias("rows_seen")).where(
        "rows_seen > 0").drop("rows_seen")


def sla_compliance(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percentage resolved in time, per class; 0 for a class without rows."""
    hours, critical = F.col("resolution_time_hours"), F.col("is_critical")

    def within(rows: Column, limit: int) -> Column:
        met = F.when(rows, F.when(hours <= limit, 1.0).otherwise(0.0))
        return F.coalesce(half_even(F.avg(met) * 100, 1), F.lit(0.0))

    return timed(df).groupBy(*by).agg(
        within(critical, CRITICAL_SLA_HOURS).alias("critical_under_48h"),
        within(~critical, NORMAL_SLA_HOURS).alias("normal_under_168h"),
    )
