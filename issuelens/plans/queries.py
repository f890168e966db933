"""Registered queries: name -> function of (spark, sf_dir).

Each asks the star reader for just the columns it needs. All of them read the
whole tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.functions import changelog, numbers, risk as scores, text
from issuelens.functions.status import finished
from issuelens.operators import (
    evaluation,
    health,
    ml,
    quality,
    recommend,
    releases,
    reopens,
    report,
    risk,
    sketches,
    summary,
    trends,
    upsert,
)
from issuelens.operators.derive import with_defaults, with_derived
from issuelens.plans import analysis
from issuelens.schema import DEFECTS
from issuelens.session import SHUFFLES_GO, discard, scratch_path, settings, staged, staged_at
from issuelens.plans import issue_json
from issuelens.sources import pages, star
from issuelens.sources.exports import write_csv
from issuelens.sources.star import CONFIG, defects, table
from issuelens.sources.store import DefectStore
from issuelens.streaming import flows, incremental

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

COMPARED = ("REL-99", "REL-00", "REL-01")
RISK_INPUT = ["key", "priority", "created", "age_days", "is_critical", "is_resolved"]
NARROW_RISKS = ["key", "project", "issue_type", "priority", "age_days", "status", "assignee",
                "created", "is_critical", "is_resolved", "text_slot"]
SUMMARY_INPUT = ["project", "is_resolved", "is_critical", "age_days", "resolution_time_hours",
                 "assignee", "priority", "has_components"]
HEALTH_INPUT = ["key", "project", "is_resolved", "is_critical", "age_days", "priority",
                "assignee", "resolution_time_hours"]


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


# Projections


@query
def defects_base(spark, sf_dir):
    return defects(spark, sf_dir, [
        "key", "project", "project_name", "issue_type", "status", "priority", "reporter",
        "assignee", "severity", "release_name", "created_day", "age_days",
        "resolution_time_hours", "is_resolved", "is_critical", "is_open", "components_str",
        "labels_str"])


@query
def resolved_flag(spark, sf_dir):
    return defects(spark, sf_dir, ["key", "status", "is_resolved"])


@query
def status_definitions(spark, sf_dir):
    return summary.status_definitions(
        defects(spark, sf_dir, ["status"]), CONFIG.resolved_statuses)


@query
def period_keys(spark, sf_dir):
    return defects(spark, sf_dir, ["key", "created_week", "created_month", "created_day"])


@query
def text_flags(spark, sf_dir):
    return defects(spark, sf_dir, [
        "key", "summary_length", "description_length", "has_description", "has_assignee",
        "has_components", "has_labels"])


@query
def text_shortened(spark, sf_dir):
    """Display truncation, unconditional and only-if-longer."""
    rows = defects(spark, sf_dir, ["key", "summary"])
    return rows.select(
        "key",
        text.shorten(F.col("summary"), 80, always=True).alias("always_80"),
        text.shorten(F.col("summary"), 100).alias("longer_100"),
    )


@query
def nan_clean(spark, sf_dir):
    event = F.col("event_id")
    dirty = (F.when(event % 7 == 0, float("nan")).when(event % 11 == 0, float("inf"))
             .when(event % 13 == 0, float("-inf")).otherwise(F.col("value")))
    rows = table(spark, sf_dir, "events").select("event_id", dirty.alias("value"))
    return numbers.clean_non_finite(rows)


@query
def raw_json(spark, sf_dir):
    """Every column that the SQL twin can write as the same JSON."""
    return upsert.raw_json(defects(spark, sf_dir, RAW_COLUMNS))


RAW_COLUMNS = ["key", "project", "project_name", "issue_type", "status", "priority", "resolution",
               "reporter", "assignee", "severity", "release_name", "created_day", "age_days",
               "is_resolved", "is_critical", "is_open", "components_str", "labels_str"]


@query
def extraction_audit(spark, sf_dir):
    order = F.col("o_orderkey")
    stamp = (F.when(order % 97 == 0, "not a date").when(order % 89 == 0, None)
             .otherwise(F.date_format("o_orderdate", issue_json.STAMP)))
    return quality.extraction_audit(
        table(spark, sf_dir, "orders").select(stamp.alias("created_raw")))


# Landed pages


PAGE_COLUMNS = ["key", "project", "project_name", "issue_type", "status", "priority", "created",
                "updated", "resolved", "resolution", "reporter", "assignee", "components", "labels",
                "affected_versions", "fix_versions", "severity", "market", "summary", "description"]


def _with_changelog(spark, sf_dir, rows):
    """Issues with the first page of the changelog of the user of the same number, some with an empty
    history; and the further pages, a row for each."""
    pairs = reopens.transition_pairs(star.state_log(spark, sf_dir))
    named = lambda c: F.when(F.col(c) == "purchase", "Resolved").otherwise(F.col(c))
    paged = reopens.nested_changelog(pairs.withColumns({
        "from_state": named("from_state"),
        "to_state": F.when(F.col("to_state") != "view", named("to_state"))}))
    logs = staged(paged.select(
        F.substring("key", 5, 20).cast("bigint").alias("number"), "page", "histories"), "changelogs")
    empty = F.array(F.struct(
        F.lit("2001-08-01T00:00:00.000+0000").alias("created"),
        F.lit(None).cast(logs.schema["histories"].dataType.elementType["items"].dataType).alias("items")))
    joined = rows.join(logs.where("page = 0").drop("page"), "number", "left")
    issues = joined.withColumn("histories", F.when(
        F.col("number") % 2 == 0, F.concat(F.coalesce("histories", F.array().cast(logs.schema["histories"].dataType)),
                                           empty)).otherwise(F.col("histories")))
    return issues, rows.select("key", "number").join(logs.where("page > 0"), "number").drop("number")


def _issues(spark, sf_dir, columns=PAGE_COLUMNS):
    rows = defects(spark, sf_dir, [*columns, "text_slot"], raw=True).withColumnRenamed("text_slot", "number")
    return rows


def _land(spark, sf_dir, rows, path):
    """Append whole issues as search pages."""
    issues = issue_json.issue_structs(rows, {"customfield_101": "market"}, "customfield_99999")
    total = table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    with settings(spark, SHUFFLES_GO):
        issue_json.search_pages(issues, total).write.mode("append").json(path, compression="gzip")


def _land_broken(spark, sf_dir, path):
    """One line per region that breaks off in the middle of a page."""
    table(spark, sf_dir, "region").select(
        F.format_string('{"startAt": %d, "issues": [{"key": ', "r_regionkey").alias("value")
    ).write.mode("append").text(path)


def _landed_pages(spark, sf_dir) -> tuple[str, str]:
    """Folders of the search pages and of the further changelog pages."""
    path, logs = scratch_path(spark, "pages"), scratch_path(spark, "changelogs")
    issues, further = _with_changelog(spark, sf_dir, _issues(spark, sf_dir))
    _land(spark, sf_dir, issues, path)
    _land_broken(spark, sf_dir, path)
    further.write.json(logs, compression="gzip")
    return path, logs


#: Issues that are landed, read and removed at once where nothing reads their pages later.
ROUND_ISSUES = 400_000


def _landed_in_rounds(spark, sf_dir) -> Iterator[str]:
    """Folders that hold the search pages of ``_landed_pages``, a bounded number of issues in each.

    All pages are landed, whole, but a folder goes when the next is asked for: disk holds one, and the
    issues without their texts.
    """
    rows = _issues(spark, sf_dir, [c for c in PAGE_COLUMNS if c not in star.TEXT_COLUMNS])
    issues, further = _with_changelog(spark, sf_dir, rows)
    further.write.json(scratch_path(spark, "changelogs"), compression="gzip")
    rounds = max(1, -(-table(spark, sf_dir, "orders").count() // ROUND_ISSUES))
    if rounds > 1:
        issues = staged(issues, "issues")
    # a page, also that of issues without a number, is in one round
    dealt = F.pmod(F.xxhash64(F.floor(F.col("number") / pages.PAGE_SIZE)), F.lit(rounds))
    for k in range(rounds):
        some = issues.where(dealt == k).withColumn("text_slot", F.col("number"))
        path = scratch_path(spark, "pages")
        _land(spark, sf_dir, star.attach_text(spark, sf_dir, some, ("summary", "description")).drop("text_slot"), path)
        if not k:
            _land_broken(spark, sf_dir, path)
        yield path
        discard(spark, path)


@query
def page_scan(spark, sf_dir):
    """Whole issues written as search pages and further changelog pages, read back and projected."""
    path, logs = _landed_pages(spark, sf_dir)
    issues = pages.project_issues(pages.read_issues(spark, path, CONFIG), CONFIG)
    further = reopens.nested_reopens(pages.read_changelogs(spark, logs), finished(CONFIG.resolved_statuses))
    counted = issues.join(further.withColumnRenamed("reopen_count", "further"), "key", "left").withColumn(
        "reopen_count", F.col("reopen_count") + F.coalesce("further", F.lit(0)))
    rows = with_derived(pages.readable(counted), CONFIG)
    return rows.select(
        "key", "project", "project_name", "issue_type", "status", "priority", "resolution", "reporter",
        "assignee", "severity", "market", "created_day", "age_days", "resolution_time_hours",
        "components_str", "labels_str", "reopen_count", "release_name", "summary", "description",
        F.date_format("updated", "yyyy-MM-dd").alias("updated_day"),
        text.joined(F.col("fix_versions")).alias("fix_versions"))


@query
def page_audit(spark, sf_dir):
    """Whole pages against the total they announce."""
    keys = None
    for path in _landed_in_rounds(spark, sf_dir):
        some = staged(quality.page_keys(pages.read_pages(spark, path, CONFIG)), "keys")
        keys = some if keys is None else keys.union(some)
    return quality.audited_keys(keys)


@query
def scan_observed(spark, sf_dir):
    """What a scan of whole pages saw, counted while its rows were written and with no read of its own."""
    counts = {}
    for path in _landed_in_rounds(spark, sf_dir):
        issues, seen = pages.observed(pages.explode_pages(pages.read_pages(spark, path, CONFIG)))
        written = scratch_path(spark, "scanned")
        staged_at(pages.judged(pages.project_issues(issues, CONFIG)), written)
        for name, n in seen.get.items():
            counts[name] = max(counts.get(name, 0), n) if name == "announced" else counts.get(name, 0) + n
        discard(spark, written)
    return spark.range(1).select(*[F.lit(counts[c]).cast("bigint").alias(c) for c in (
        "announced", "fetched", "unreadable", "extracted", "corrupt")])


# Scans, store and releases


@query
def scan_filter(spark, sf_dir):
    rows = defects(spark, sf_dir, ["key", "severity", "issue_type", "affected_versions",
                                   "created", "created_day"])
    return upsert.scan_filter(rows, CONFIG.defect_issue_types, "REL-99", by_severity=True).select(
        "key", "severity", "issue_type", "created_day")


def _batches(spark, sf_dir):
    """Two deliveries of stored rows; the second changes every third issue."""
    order = F.col("text_slot")
    first = defects(spark, sf_dir, ["key", "release_name", "status", "priority", "text_slot"])
    first = first.withColumn("batch_ts", F.lit("2001-08-01").cast("timestamp"))
    second = first.where(order % 3 == 0).withColumns({
        "status": F.lit("Closed"),
        "batch_ts": F.lit("2001-08-02").cast("timestamp"),
        "key": F.when(order % 30 != 0, F.col("key")),
    })
    return first.drop("text_slot"), second.drop("text_slot")


@query
def upsert_latest(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    return upsert.upsert(old, new).drop("batch_ts")


@query
def upsert_rejected(spark, sf_dir):
    return upsert.rejected(_batches(spark, sf_dir)[1])


def _registry(spark, sf_dir):
    """Release registry: the years of the orders and of the events."""
    def years(name: str, column: str) -> DataFrame:
        return table(spark, sf_dir, name).groupBy(F.year(column).alias("year")).agg(
            F.min(column).alias("created_at"))

    return years("orders", "o_orderdate").unionByName(years("events", "ts")).select(
        F.concat(F.lit("REL-"), F.lpad((F.col("year") % 100).cast("string"), 2, "0")).alias("name"),
        F.concat(F.lit("Release of "), F.col("year")).alias("description"),
        "created_at",
        (F.col("year") % 4 != 0).alias("is_active"),
    )


@query
def release_register(spark, sf_dir):
    everything = _registry(spark, sf_dir)
    known = everything.where("is_active")
    again = everything.withColumn("description", F.lit("registered again"))
    return releases.register(known, again).select("name", "description", "is_active")


def _store_read(spark, sf_dir, status_filter):
    rows = defects(spark, sf_dir, ["key", "release_name", "status", "created", "created_day",
                                   "components", "labels"])
    picked = upsert.select_defects(
        rows, _registry(spark, sf_dir).where("is_active"),
        ["REL-97", "REL-98", "REL-00", "REL-24"], status_filter)
    return picked.select(
        "key", "release_name", "status", "created_day",
        text.joined(F.col("components")).alias("components"),
        text.joined(F.col("labels")).alias("labels"))


@query
def store_read_open(spark, sf_dir):
    return _store_read(spark, sf_dir, "open")


@query
def store_read_closed(spark, sf_dir):
    return _store_read(spark, sf_dir, "closed")


STORED_COLUMNS = [f.name for f in DEFECTS.fields if f.name not in ("custom", "changelog")]


def _filled_store(spark, sf_dir) -> DefectStore:
    """Whole issues, then every third of them changed, a few without a key."""
    store = DefectStore(spark, scratch_path(spark, "store"))
    rows = staged(defects(spark, sf_dir, [*STORED_COLUMNS, "text_slot"]), "issues")
    order = F.col("text_slot")
    changed = rows.where(order % 3 == 0).withColumns({
        "status": F.lit("Closed"), "key": F.when(order % 30 != 0, F.col("key"))})
    store.store_defects(rows.drop("text_slot"))
    store.store_defects(changed.drop("text_slot"))
    return store


@query
def store_roundtrip(spark, sf_dir):
    """Two upserts into a written store, then its per-release counts."""
    store = _filled_store(spark, sf_dir)
    return store.releases_with_counts().select("name", "total_defects", "open_defects")


@query
def store_rows(spark, sf_dir):
    """The stored issues, whole, after compaction."""
    store = _filled_store(spark, sf_dir)
    store.compact()
    return store.defects().select(
        "key", "release_name", "project", "status", "priority", "resolution", "severity", "assignee",
        "summary", "description", F.date_format("updated", "yyyy-MM-dd").alias("updated_day"),
        text.joined(F.col("fix_versions")).alias("fix_versions"),
        F.get_json_object("raw_data", "$.status").alias("raw_status"))


@query
def store_rejects(spark, sf_dir):
    return _filled_store(spark, sf_dir).rejects().groupBy("reason").agg(F.count("*").alias("n"))


CSV_COLUMNS = ["key", "project", "project_name", "issue_type", "status", "priority", "resolution",
               "reporter", "assignee", "severity", "release_name", "created_day", "age_days",
               "resolution_time_hours", "is_resolved", "is_critical", "is_open", "components", "labels",
               "summary", "description"]


@query
def csv_roundtrip(spark, sf_dir):
    """Whole issues exported as CSV, lists joined, line breaks kept, and read back."""
    path = scratch_path(spark, "csv")
    rows = defects(spark, sf_dir, CSV_COLUMNS)
    write_csv(rows, path, "gzip")
    kinds = {name: kind if not kind.startswith("array") else "string" for name, kind in rows.dtypes}
    # An empty text and a missing one are written alike; both columns are never missing here.
    return (spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True)
            .option("escape", '"').option("lineSep", "\n")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .schema(", ".join(f"{name} {kind}" for name, kind in kinds.items())).csv(path))


@query
def results_roundtrip(spark, sf_dir):
    """Analysis sections appended to a written store and read back."""
    store = DefectStore(spark, scratch_path(spark, "results"))
    rows = defects(spark, sf_dir, ["release_name", "project", "is_resolved", "age_days"])
    counts = rows.groupBy("release_name", "project").agg(
        F.count(F.lit(1)).alias("total_defects"),
        F.count_if(~F.col("is_resolved")).alias("open_defects"),
        F.max("age_days").alias("oldest"))
    store.add_releases(counts.select(F.col("release_name").alias("name")))
    store.store_results(counts, "projects")
    read = store.get_results(
        ["REL-99", "REL-00"], "projects",
        "project string, total_defects bigint, open_defects bigint, oldest bigint")
    return read.select("release_name", "analysis_type", "results.*")


@query
def releases_with_counts(spark, sf_dir):
    rows = defects(spark, sf_dir, ["release_name", "status"])
    return releases.with_counts(_registry(spark, sf_dir), rows).select(
        "name", "total_defects", "open_defects")


@query
def release_semi(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where(F.year("o_orderdate") >= 2000).select(
        F.concat(F.lit("REL-"), F.date_format("o_orderdate", "yy")).alias("release_name")
    ).distinct()
    rows = defects(spark, sf_dir, ["key", "release_name", "status"])
    return releases.in_releases(rows, wanted)


@query
def release_union(spark, sf_dir):
    with_severity = releases.in_releases(
        defects(spark, sf_dir, ["key", "release_name", "severity"]), ["REL-95"])
    without = releases.in_releases(defects(spark, sf_dir, ["key", "release_name"]), ["REL-96"])
    return releases.union_releases([with_severity, without])


@query
def release_sequence(spark, sf_dir):
    """Predecessors of yearly and monthly release names, with their volume."""
    orders = table(spark, sf_dir, "orders")
    yearly = F.concat(F.lit("REL-"), F.date_format("o_orderdate", "yy"))
    monthly = F.date_format("o_orderdate", "yyyy-MM")
    volume = orders.select(F.explode(F.array(yearly, monthly)).alias("release_name")).groupBy(
        "release_name").agg(F.count(F.lit(1)).alias("n_defects"))
    steps = releases.sequence_rows(
        volume.select(F.col("release_name").alias("current")), "current", 4,
        CONFIG.releases_per_year)
    return steps.join(volume, "release_name", "left").select(
        "current", "position", "release_name",
        F.coalesce("n_defects", F.lit(0)).alias("n_defects"))


@query
def release_comparison(spark, sf_dir):
    rows = defects(spark, sf_dir, ["release_name", "project", "age_days", "is_resolved",
                                   "is_critical", "priority"])
    return analysis.release_comparison(rows)


@query
def release_distributions(spark, sf_dir):
    rows = defects(spark, sf_dir, ["release_name", "priority", "issue_type", "severity"])
    return summary.value_counts(rows, ["priority", "issue_type", "severity"], ["release_name"])


@query
def release_projects(spark, sf_dir):
    rows = defects(spark, sf_dir, ["release_name", "project", "issue_type", "is_resolved",
                                   "is_critical", "age_days"])
    out = summary.project_breakdown(rows, ["release_name"])
    return out.withColumn("avg_age", numbers.half_even(F.col("avg_age"), 6))


@query
def release_aging(spark, sf_dir):
    rows = defects(spark, sf_dir, ["release_name", "age_days"])
    return health.age_histogram(rows, ["release_name"])


@query
def release_top_risks(spark, sf_dir):
    rows = defects(spark, sf_dir, [*RISK_INPUT, "release_name", "project"])
    return risk.top_risks_by(risk.with_risk(rows), ["release_name"], 5).select(
        "release_name", "position", "key", "project", "risk_score")


@query
def release_oldest_open(spark, sf_dir):
    rows = defects(spark, sf_dir, ["release_name", "key", "project", "age_days", "created",
                                   "is_resolved"])
    return health.oldest_open_by(rows, ["release_name"])


@query
def release_severities(spark, sf_dir):
    return summary.severity_profile(
        defects(spark, sf_dir, ["release_name", "severity"]), by=["release_name"])


@query
def release_recommendations(spark, sf_dir):
    rows = defects(spark, sf_dir, ["release_name", "project", "severity", "is_critical",
                                   "is_resolved", "age_days"])
    return recommend.quick_recommendations(rows, ["release_name"]).drop("position")


@query
def store_stats(spark, sf_dir):
    rows = defects(spark, sf_dir, ["release_name", "status"])
    per_type = rows.groupBy("release_name", "status").count()
    return upsert.store_stats(_registry(spark, sf_dir), rows, per_type)


# Summaries and distributions


@query
def summary_comprehensive(spark, sf_dir):
    return summary.comprehensive_summary(defects(spark, sf_dir, SUMMARY_INPUT))


REGISTRY["summary"] = REGISTRY.pop("summary_comprehensive")


@query
def summary_empty(spark, sf_dir):
    rows = defects(spark, sf_dir, SUMMARY_INPUT).where(F.col("project") == "NO SUCH PROJECT")
    return summary.comprehensive_summary(rows)


@query
def summary_quick(spark, sf_dir):
    rows = defects(spark, sf_dir, ["project", "is_resolved", "is_critical", "age_days", "priority"])
    return summary.quick_summary(
        rows, newest=defects(spark, sf_dir, ["key", "created", "release_name"]))


@query
def summary_web(spark, sf_dir):
    rows = defects(spark, sf_dir, ["status", "priority", "release_name"])
    return summary.web_summary(rows, COMPARED, critical_priorities=("Highest", "Blocker"))


@query
def value_counts(spark, sf_dir):
    return summary.value_counts(
        defects(spark, sf_dir, analysis.VALUE_COLUMNS), analysis.VALUE_COLUMNS)


@query
def value_counts_grouping_sets(spark, sf_dir):
    return summary.value_counts_grouping_sets(
        defects(spark, sf_dir, analysis.VALUE_COLUMNS), analysis.VALUE_COLUMNS)


@query
def severity_profile(spark, sf_dir):
    return summary.severity_profile(defects(spark, sf_dir, ["severity"]))


@query
def project_breakdown(spark, sf_dir):
    out = summary.project_breakdown(defects(spark, sf_dir, [
        "project", "issue_type", "is_resolved", "is_critical", "age_days"]))
    return out.withColumn("avg_age", numbers.half_even(F.col("avg_age"), 6))


@query
def cross_project(spark, sf_dir):
    return summary.cross_project_insights(
        defects(spark, sf_dir, ["project", "is_critical", "is_resolved", "age_days"]))


@query
def critical_by_project(spark, sf_dir):
    return summary.critical_by_project(defects(spark, sf_dir, ["project", "is_critical"]))


@query
def critical_components(spark, sf_dir):
    rows = defects(spark, sf_dir, ["components", "is_critical"]).where("is_critical")
    return summary.top_components(rows, 10)


@query
def pattern_summary(spark, sf_dir):
    rows = defects(spark, sf_dir, ["status", "priority", "issue_type", "age_days"])
    return summary.pattern_summary(rows, components=defects(spark, sf_dir, ["components"]))


@query
def pattern_sample(spark, sf_dir):
    """Five hash-picked issues with shortened summaries."""
    picked = summary.sample_rows(defects(spark, sf_dir, ["key", "text_slot"]))
    rows = star.attach_text_to_few(spark, sf_dir, picked, 5)
    return rows.select("key", F.substring("summary", 1, 100).alias("summary"))


# Health, ageing, workload


def _health(spark, sf_dir):
    return health.project_health(defects(spark, sf_dir, HEALTH_INPUT))


@query
def project_health(spark, sf_dir):
    return _health(spark, sf_dir)


@query
def project_health_top5(spark, sf_dir):
    return health.healthiest(_health(spark, sf_dir)).select(
        "project", "health_score", "open_defects")


@query
def health_band(spark, sf_dir):
    return health.health_bands(_health(spark, sf_dir))


@query
def age_histogram(spark, sf_dir):
    return health.age_histogram(defects(spark, sf_dir, ["age_days"]))


@query
def aging_project(spark, sf_dir):
    return health.aging_by_project(defects(spark, sf_dir, ["project", "age_days", "is_resolved"]))


@query
def aging_priority(spark, sf_dir):
    return health.aging_by(
        defects(spark, sf_dir, ["priority", "age_days", "is_resolved"]), "priority")


@query
def aging_issue_type(spark, sf_dir):
    return health.aging_by(
        defects(spark, sf_dir, ["issue_type", "age_days", "is_resolved"]), "issue_type")


@query
def oldest_open(spark, sf_dir):
    return health.oldest_open(
        defects(spark, sf_dir, ["key", "project", "age_days", "created", "is_resolved"]))


@query
def aging_thresholds(spark, sf_dir):
    return health.aging_thresholds(defects(spark, sf_dir, ["age_days", "is_resolved"]))


@query
def assignee_workload(spark, sf_dir):
    return health.assignee_workload(defects(spark, sf_dir, [
        "key", "assignee", "is_resolved", "is_critical", "age_days", "resolution_time_hours"]))


@query
def component_stats(spark, sf_dir):
    return health.component_stats(defects(spark, sf_dir, [
        "key", "components", "is_resolved", "is_critical", "age_days"]))


@query
def resolution_percentiles(spark, sf_dir):
    return health.resolution_percentiles(
        defects(spark, sf_dir, ["is_resolved", "resolution_time_hours"]))


@query
def percentile_sketches(spark, sf_dir):
    """Percentiles per release from sketches per release and week, stored in three deliveries and merged on
    read, against the exact ones: how many are within the stated error of rank."""
    rows = staged(defects(spark, sf_dir, ["release_name", "created_week", "age_days", "is_resolved",
                                          "resolution_time_hours"]), "timed")
    store = DefectStore(spark, scratch_path(spark, "sketches"))
    for k in range(3):
        part = sketches.resolution_sketches(rows.where(F.col("age_days") % 3 == k))
        store.store_sketches(part, "resolution", f"{k:03d}")
    parts = store.sketches("resolution", part.schema)
    found = sketches.percentiles(parts, ["release_name"])
    far = sketches.rank_distances(health.timed(rows), "resolution_time_hours", found, ["release_name"])
    exact = health.resolution_percentiles(rows, by=["release_name"])
    return far.groupBy("release_name").agg(
        F.max("n").alias("n"), F.count("*").alias("percentiles"),
        F.count_if(F.col("distance") <= 2 * sketches.rank_error()).alias("within_error")).join(exact, "release_name")


@query
def sla_compliance(spark, sf_dir):
    return health.sla_compliance(
        defects(spark, sf_dir, ["is_resolved", "is_critical", "resolution_time_hours"]))


# The full report per release


BY_RELEASE = ["release_name"]


@query
def release_trend_weekly(spark, sf_dir):
    rows = defects(spark, sf_dir, [*BY_RELEASE, "key", "created_week", "is_critical"])
    return trends.weekly_trend(rows, 4, BY_RELEASE)


@query
def release_trend_monthly(spark, sf_dir):
    rows = defects(spark, sf_dir, [*BY_RELEASE, "key", "created_month", "is_resolved"])
    return trends.monthly_trend(rows, 3, BY_RELEASE)


@query
def release_trend_severity(spark, sf_dir):
    rows = defects(spark, sf_dir, [*BY_RELEASE, "created_month", "is_critical", "priority"])
    return trends.severity_trend(rows, 3, BY_RELEASE)


@query
def release_aging_project(spark, sf_dir):
    return health.aging_by_project(
        defects(spark, sf_dir, [*BY_RELEASE, "project", "age_days", "is_resolved"]), BY_RELEASE)


@query
def release_aging_priority(spark, sf_dir):
    return health.aging_by(
        defects(spark, sf_dir, [*BY_RELEASE, "priority", "age_days", "is_resolved"]), "priority", BY_RELEASE)


@query
def release_workload(spark, sf_dir):
    return health.assignee_workload(defects(spark, sf_dir, [
        *BY_RELEASE, "key", "assignee", "is_resolved", "is_critical", "age_days",
        "resolution_time_hours"]), 5, BY_RELEASE)


@query
def release_components(spark, sf_dir):
    return health.component_stats(defects(spark, sf_dir, [
        *BY_RELEASE, "key", "components", "is_resolved", "is_critical", "age_days"]), 5, BY_RELEASE)


@query
def release_percentiles(spark, sf_dir):
    return health.resolution_percentiles(
        defects(spark, sf_dir, [*BY_RELEASE, "is_resolved", "resolution_time_hours"]), by=BY_RELEASE)


@query
def release_sla(spark, sf_dir):
    return health.sla_compliance(defects(spark, sf_dir, [
        *BY_RELEASE, "is_resolved", "is_critical", "resolution_time_hours"]), BY_RELEASE)


@query
def release_advice(spark, sf_dir):
    return recommend.comprehensive_recommendations(
        defects(spark, sf_dir, [*BY_RELEASE, *RECOMMEND_INPUT]), BY_RELEASE).drop("position")


# Trends


@query
def trend_weekly(spark, sf_dir):
    return trends.weekly_trend(defects(spark, sf_dir, ["key", "created_week", "is_critical"]))


@query
def trend_monthly(spark, sf_dir):
    return trends.monthly_trend(defects(spark, sf_dir, ["key", "created_month", "is_resolved"]))


@query
def severity_trend(spark, sf_dir):
    return trends.severity_trend(
        defects(spark, sf_dir, ["created_month", "is_critical", "priority"]))


@query
def trendline(spark, sf_dir):
    rows = defects(spark, sf_dir, ["release_name", "created"])
    return _day_text(trends.trendline(rows, COMPARED))


def _day_text(df: DataFrame) -> DataFrame:
    return df.select("release_name", F.date_format("day", "yyyy-MM-dd").alias("day"),
                     "daily_count", "cumulative_count")


# Changelog


_LOG_RESOLVED = finished(star.LOG_FINISHED)


def _reopens(spark, sf_dir):
    return reopens.reopen_counts(
        star.issue_list(spark, sf_dir), star.state_log(spark, sf_dir), _LOG_RESOLVED)


@query
def transition_pairs(spark, sf_dir):
    return reopens.transition_pairs(star.state_log(spark, sf_dir)).select(
        "key", "seq", "from_state", "to_state")


@query
def reopen_flat(spark, sf_dir):
    return _reopens(spark, sf_dir).select("key", "reopen_count")


@query
def reopen_nested(spark, sf_dir):
    paged = reopens.nested_changelog(reopens.transition_pairs(star.state_log(spark, sf_dir)))
    return reopens.nested_reopens(paged, _LOG_RESOLVED)


@query
def reopen_summary(spark, sf_dir):
    return reopens.reopen_summary(_reopens(spark, sf_dir))


@query
def reopen_distribution(spark, sf_dir):
    return reopens.reopen_distribution(_reopens(spark, sf_dir))


@query
def most_reopened(spark, sf_dir):
    return risk.most_reopened(_reopens(spark, sf_dir))


# Write-ups


def _scores(spark, sf_dir):
    return quality.writeup_scores(star.writeups(spark, sf_dir))


@query
def writeup_quality(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("missing", text.joined(F.col("missing")))


@query
def writeup_poor_rate(spark, sf_dir):
    return quality.poor_rate(_scores(spark, sf_dir))


@query
def writeup_missing(spark, sf_dir):
    return quality.missing_frequency(_scores(spark, sf_dir))


# Risk


@query
def risk_linear(spark, sf_dir):
    rows = defects(spark, sf_dir, RISK_INPUT)
    scored = risk.with_risk(risk.with_risk(rows), None, "risk_score_raw")
    return scored.select("key", "risk_score",
                         numbers.half_even(F.col("risk_score_raw"), 6).alias("risk_score_raw"))


@query
def risk_fallback(spark, sf_dir):
    scored = risk.with_fallback_risk(defects(spark, sf_dir, RISK_INPUT))
    return scored.select(
        "key", numbers.half_even(F.col("overall_risk_score"), 6).alias("overall_risk_score"))


@query
def risk_band(spark, sf_dir):
    scored = risk.with_risk(defects(spark, sf_dir, RISK_INPUT))
    return scored.select(
        "key", "risk_score",
        numbers.band(F.col("risk_score"), *scores.RISK_BANDS_STRICT).alias("band_strict"),
        numbers.band(F.col("risk_score"), *scores.RISK_BANDS_WIDE).alias("band_wide"),
    )


def _top_risks(spark, sf_dir):
    """Ranks narrow rows; only the winners get their text."""
    top = risk.top_risks(risk.with_risk(defects(spark, sf_dir, NARROW_RISKS)))
    return risk.ranked(with_defaults(star.attach_text_to_few(spark, sf_dir, top, 25)))


@query
def top_risks(spark, sf_dir):
    return _top_risks(spark, sf_dir).select(*risk.RISK_COLUMNS)


# Recommendations and reports


RECOMMEND_INPUT = ["project", "is_critical", "is_resolved", "age_days", "assignee", "priority"]


@query
def recommendations(spark, sf_dir):
    return recommend.comprehensive_recommendations(
        defects(spark, sf_dir, RECOMMEND_INPUT)).drop("position")


@query
def recommendations_quick(spark, sf_dir):
    return recommend.quick_recommendations(defects(spark, sf_dir, [
        "project", "severity", "is_critical", "is_resolved", "age_days"])).drop("position")


REPORT_INPUT = [*dict.fromkeys([*NARROW_RISKS, *SUMMARY_INPUT, *HEALTH_INPUT])]


@query
def report_long(spark, sf_dir):
    base = staged(defects(spark, sf_dir, REPORT_INPUT), "report")
    top = risk.top_risks(risk.with_risk(base))
    return report.report_long(
        summary.comprehensive_summary(base),
        health.project_health(base),
        recommend.comprehensive_recommendations(base),
        with_defaults(star.attach_text_to_few(spark, sf_dir, top, 25)),
    ).drop("section_no", "metric_no")


@query
def preview_100(spark, sf_dir):
    rows = report.preview(defects(spark, sf_dir, [
        "key", "project", "status", "priority", "release_name", "created", "created_day",
        "age_days", "text_slot"]))
    rows = star.attach_text_to_few(spark, sf_dir, rows, 100)
    return rows.orderBy(F.col("created").desc(), "key").drop("created", "text_slot")


@query
def invariants(spark, sf_dir):
    base = staged(defects(spark, sf_dir, [*dict.fromkeys([*HEALTH_INPUT, *SUMMARY_INPUT])]), "checks")
    fixed = base.where("is_resolved").withColumn("project", F.lit("ALL FIXED"))
    return quality.invariants(
        summary.comprehensive_summary(base),
        health.project_health(base),
        health.project_health(fixed),
        reopens.reopen_summary(_reopens(spark, sf_dir)),
        quality.poor_rate(_scores(spark, sf_dir)),
        summary.comprehensive_summary(base.where(F.col("project") == "NO SUCH PROJECT")),
    )


# Models


FEATURE_INPUT = ["key", "project", "priority", "status", "issue_type", "reporter", "assignee",
                 "severity", "created", "age_days", "is_critical", "is_resolved",
                 "has_components", "summary_length", "description_length", "text_slot"]


@query
def ml_features(spark, sf_dir):
    rows = defects(spark, sf_dir, [
        "key", "priority", "status", "issue_type", "age_days", "is_critical", "has_components",
        "summary_length", "description_length"])
    return ml.with_features(rows, CONFIG).select(
        "key", "is_high_priority", "is_critical_issue", "needs_attention", "summary_length",
        "description_length", "has_components", "age_bucket", "status_encoded",
        "issue_type_severity",
        numbers.half_even(F.col("issue_type_severity_norm"), 6).alias("issue_type_severity_norm"))


@query
def label_encode(spark, sf_dir):
    rows = defects(spark, sf_dir, ["key", *ml.ENCODED])
    return ml.encode(rows, ml.fit_labels(rows)).select(
        "key", *[f"{c}_encoded" for c in ml.ENCODED])


@query
def label_extend(spark, sf_dir):
    """Codes of a table fitted on the older releases and extended by the others."""
    rows = defects(spark, sf_dir, ["key", "release_name", *ml.ENCODED])
    older = rows.where(F.col("release_name").isin(["REL-95", "REL-96"]))
    labels = ml.extend_labels(ml.fit_labels(older), rows)
    return ml.encode(rows, labels).select("key", *[f"{c}_encoded" for c in ml.ENCODED])


def _enrichment(spark, sf_dir):
    """Assessments for the labelled documents, keyed like the write-ups."""
    doc = F.col("doc_id")
    level = (F.when(doc % 10 == 3, "unheard of").when(F.col("toxic") == 1, "critical")
             .when(F.col("quality") == 1, "high").otherwise("low"))
    impact = (F.when(doc % 4 == 0, "Severe outage").when(doc % 4 == 1, "Moderate slowdown")
              .when(doc % 4 == 2, "cosmetic"))
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("DOC-"), doc).alias("key"), level.alias("level"),
        impact.alias("user_impact"))


@query
def enrichment_scores(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("DOC-"), F.col("doc_id")).alias("key"))
    return ml.with_enrichment(keys, _enrichment(spark, sf_dir))


@query
def enrichment_newest(spark, sf_dir):
    """Every second write-up assessed again, later: the later assessment counts."""
    first = _enrichment(spark, sf_dir).withColumn("created_at", F.lit("2001-01-01").cast("timestamp"))
    even = F.substring("key", 5, 20).cast("bigint") % 2 == 0
    again = first.where(even).withColumns({
        "level": F.lit("low"), "created_at": F.lit("2001-02-01").cast("timestamp")})
    keys = table(spark, sf_dir, "documents").select(F.concat(F.lit("DOC-"), F.col("doc_id")).alias("key"))
    return ml.with_enrichment(keys, again.union(first))


@query
def predictions_roundtrip(spark, sf_dir):
    """An exact score stored as predictions and read back."""
    store = DefectStore(spark, scratch_path(spark, "predictions"))
    scored = risk.with_risk(defects(spark, sf_dir, [*RISK_INPUT, "release_name"]))
    store.store_predictions(scored.select("key", "release_name", "risk_score"), "linear", "risk_score")
    return store.predictions().select(
        "key", "release_name", "model_type", "risk_score",
        F.get_json_object("prediction_data", "$.key").alias("data_key"))


@query
def risk_blend(spark, sf_dir):
    """The blend formula over given scores, with and without assessments."""
    rows = defects(spark, sf_dir, ["key", "priority", "status", "issue_type", "age_days",
                                   "is_critical", "has_components"])
    given = ml.with_features(rows, CONFIG).withColumns({
        "priority_risk_score": F.col("is_high_priority").cast("double"),
        "attention_score": F.col("needs_attention").cast("double"),
        "critical_score": F.col("is_critical_issue").cast("double"),
        "ai_severity_score": ml.level_score(F.lower("priority")),
    })
    both = ml.blend(ml.blend(given, "plain", enriched=False), "assessed", enriched=True)

    def six(name: str) -> Column:
        return numbers.half_even(F.col(name), 6).alias(name)

    return both.select("key", six("plain"), six("assessed"))


def _learned(spark, sf_dir):
    return ml.score_risks(defects(spark, sf_dir, FEATURE_INPUT), CONFIG)


@query
def risk_ml(spark, sf_dir):
    return _learned(spark, sf_dir).select("key", *ml.SCORES.values(), "overall_risk_score")


@query
def risk_ml_quality(spark, sf_dir):
    """Accuracy and area under the curve of the three forests, over the issues none was fitted on."""
    rows, labels = ml.prepare(defects(spark, sf_dir, FEATURE_INPUT), CONFIG)
    return ml.model_quality(rows, ml.train(rows, labels))


def _given_scores(spark, sf_dir):
    """Ages as scores of how critical an issue is."""
    rows = defects(spark, sf_dir, ["release_name", "age_days", "is_critical"])
    return rows.select("release_name", (F.col("age_days") / 128).alias("score"), "is_critical")


@query
def score_evaluation(spark, sf_dir):
    """Area under the curve and accuracy of given scores, per release."""
    rows = _given_scores(spark, sf_dir)
    area = evaluation.area_under_curve(rows, "score", "is_critical", ["release_name"])
    right = evaluation.accuracy(rows, "score", "is_critical", ["release_name"])
    return area.join(right, "release_name").select(
        "release_name", "n", "positives", "negatives", numbers.half_even(F.col("auc"), 9).alias("auc"),
        numbers.half_even(F.col("accuracy"), 9).alias("accuracy"))


@query
def score_calibration(spark, sf_dir):
    return evaluation.calibration(_given_scores(spark, sf_dir), "score", "is_critical")


@query
def top_risks_given(spark, sf_dir):
    """The ranking of learned scores, over given ones."""
    rows = defects(spark, sf_dir, ["key", "priority", "status", "issue_type", "age_days", "created", "is_critical",
                                   "has_components"])
    given = ml.with_features(rows, CONFIG).withColumns({
        "priority_risk_score": F.col("is_high_priority").cast("double"),
        "attention_score": F.col("needs_attention").cast("double"),
        "critical_score": F.col("is_critical_issue").cast("double")})
    scored = ml.blend(given, "plain", enriched=False).withColumn("risk_score", numbers.half_even(F.col("plain"), 6))
    return risk.top_risks(scored).select("key", "issue_type", "priority", "age_days", "risk_score")


@query
def risk_ml_checks(spark, sf_dir):
    """What is exact about the learned scores: every issue has one, all are within
    bounds, the blend follows from its parts, and the ranking is its top."""
    scored = staged(_learned(spark, sf_dir), "scored")
    parts = [F.col(c) for c in (*ml.SCORES.values(), "overall_risk_score")]
    bounded = F.lit(True)
    for part in parts:
        bounded = bounded & part.between(0, 1)
    again = ml.blend(scored, "again")
    best = scored.agg(F.max("overall_risk_score")).scalar()
    top = risk.top_risks(scored, 1, "overall_risk_score").select("overall_risk_score").scalar()
    return again.agg(
        F.count("*").alias("scored"), F.count_distinct("key").alias("issues"),
        F.count_if(bounded).alias("bounded"),
        F.count_if(F.abs(F.col("again") - F.col("overall_risk_score")) < 1e-12).alias("blended"),
    ).withColumn("ranked", best == top)


@query
def top_risks_ml(spark, sf_dir):
    top = risk.top_risks(_learned(spark, sf_dir), score="overall_risk_score")
    rows = with_defaults(star.attach_text_to_few(spark, sf_dir, top, 25)).withColumnRenamed(
        "overall_risk_score", "risk_score")
    return risk.ranked(rows).select(*risk.RISK_COLUMNS)


# Streams


def _streamed(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _landed(spark, landings, path, follow):
    """Land frames one after another, with the stream run to its end after each."""
    for rows in landings:
        rows.write.mode("append").parquet(path)
        follow(_streamed(spark, path)).awaitTermination()


@query
def stream_daily_counts(spark, sf_dir):
    """Discoveries per release and day, followed over three landings.

    First come the newest issues, and outdated versions of every fourth, on a
    wrong day or on none; then the older issues and a third of all once more;
    last some outdated versions that nothing may follow from.
    """
    def dated(rows, day, stamp):
        return rows.select("key", "release_name", day.alias("created"),
                           F.lit(stamp).cast("timestamp_ntz").alias("updated"))

    issues = staged(defects(spark, sf_dir, ["key", "release_name", "created", "age_days", "text_slot"]), "issues")
    created, number, new = F.col("created"), F.col("text_slot"), F.col("age_days") < 30
    wrong = F.when(number % 8 == 0, created + F.expr("interval 3 days"))
    early = created - F.expr("interval 7 days")
    path, changes = scratch_path(spark, "daily"), scratch_path(spark, "daily-changes")
    _landed(spark, [
        dated(issues.where(number % 4 == 0), wrong, "2001-07-01").union(
            dated(issues.where(new), created, "2001-08-01")),
        dated(issues.where(~new | (number % 3 == 0)), created, "2001-08-01"),
        dated(issues.where(number % 5 == 0), early, "2001-06-01"),
    ], path, lambda rows: incremental.follow_daily_counts(rows, changes, f"{changes}-log"))
    return _day_text(incremental.daily_totals(spark, changes))


@query
def stream_reopens(spark, sf_dir):
    """Reopens from a stream of transitions, the later half of each month first,
    a third of them twice; the totals are read from the stream's state."""
    pairs = staged(reopens.transition_pairs(star.state_log(spark, sf_dir)), "transitions")
    late = F.dayofmonth("ts") > 15
    path, changes = scratch_path(spark, "reopens"), scratch_path(spark, "reopens-changes")
    _landed(spark, [pairs.where(late), pairs.where(~late), pairs.where("seq % 3 = 0")], path,
            lambda rows: incremental.follow_reopens(rows, _LOG_RESOLVED, changes, f"{changes}-log"))
    return incremental.reopen_totals(spark, f"{changes}-log")


def _ingested(spark, sf_dir) -> tuple[DefectStore, str]:
    """Two landings of whole pages: new issues first; then the older ones, a third of
    all with an outdated status, and what cannot be stored. And the folder of further changelog pages."""
    root = scratch_path(spark, "ingest")
    store, landed, logs = DefectStore(spark, root), f"{root}-pages", f"{root}-changelogs"
    rows, further = _with_changelog(spark, sf_dir, _issues(spark, sf_dir))
    rows = staged(rows, "issues")
    further.write.json(logs, compression="gzip")
    number, new = F.col("number"), F.col("created") >= F.lit("2001-07-01").cast("timestamp_ntz")
    outdated = rows.where(number % 3 == 0).withColumns({
        "status": F.lit("Outdated"), "updated": F.lit("1990-01-01").cast("timestamp_ntz")})
    nothing = F.lit(None)
    failing = [
        rows.where(number % 5 == 0).withColumn("key", nothing.cast("string")),
        rows.where(number % 7 == 0).withColumn("affected_versions", nothing.cast("array<string>")),
        rows.where(number % 11 == 0).withColumn("created_text", F.lit("not a date")),
    ]
    for landing in ([rows.where(new)], [rows.where(~new), outdated, *failing]):
        for part in landing:
            _land(spark, sf_dir, part, landed)
        if len(landing) > 1:
            _land_broken(spark, sf_dir, landed)
        flows.ingest_pages(spark, landed, CONFIG, store, f"{root}-log").awaitTermination()
    return store, logs


def _digest(text: str) -> Column:
    """A number that SQL has too, to be summed."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 10).cast("bigint")


@query
def stream_ingest(spark, sf_dir):
    """Whole landed pages upserted into a store by a stream: issues, their texts and their reopens per release."""
    store, logs = _ingested(spark, sf_dir)
    resolved = finished(CONFIG.resolved_statuses)
    further = reopens.nested_reopens(pages.read_changelogs(spark, logs), resolved)
    rows = store.defects().select(
        "key", "release_name", (_digest("summary") + _digest("description")).alias("digest"),
        changelog.reopen_count(F.col("changelog"), resolved).alias("first"))
    texts = rows.join(further, "key", "left").groupBy(F.col("release_name").alias("name")).agg(
        F.sum("digest").alias("text_digest"),
        F.sum(F.col("first") + F.coalesce("reopen_count", F.lit(0))).alias("reopens"))
    counts = store.releases_with_counts().select("name", "total_defects", "open_defects")
    return counts.join(texts, "name")


@query
def stream_rejects(spark, sf_dir):
    """What the stream could not store, by reason."""
    return _ingested(spark, sf_dir)[0].rejects().groupBy("reason").agg(F.count("*").alias("n"))


@query
def stream_audit(spark, sf_dir):
    """What the stream saw of its batches while it stored them."""
    counts = ("fetched", "unreadable", "extracted", "corrupt", "stored", "rejected")
    return _ingested(spark, sf_dir)[0].audits().agg(
        F.max("announced").alias("announced"), *[F.sum(c).alias(c) for c in counts])
