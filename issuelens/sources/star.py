"""Issues, changelogs and write-ups read from an order-processing star schema.

Each builder takes the columns the caller wants and joins only the tables
those columns come from, so a query over statuses reads nothing but orders.
Join sides are left to the optimizer: a dimension is broadcast only when its
measured size is under the session's threshold, and shuffled otherwise, where
adaptive execution splits skewed join partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.config import AnalysisConfig
from issuelens.operators.derive import with_defaults, with_derived
from issuelens.session import checkpoint_root

# Fixed values of the mapping.
AS_OF = datetime(2001, 8, 2)
CONFIG = AnalysisConfig(
    as_of=AS_OF,
    defect_issue_types=("PROMO", "ECONOMY", "LARGE"),
    critical_issue_types=("PROMO", "ECONOMY"),
    current_release="REL-01",
    custom_fields={"market": "customfield_101"},
    severity_field="99999",
)
PRIORITIES = {
    "1-URGENT": "Highest",
    "2-HIGH": "High",
    "3-MEDIUM": "Medium",
    "5-LOW": "Low",
}
FINISHED_STATUSES = ("Resolved", "Closed", " done ")
SEVERITIES = {"R": "S1", "A": "S2", "N": "S3"}

ORDER_COLUMNS = {"key", "status", "priority", "resolution", "release_name", "affected_versions",
                 "fix_versions"}
CUSTOMER_COLUMNS = {"project", "reporter", "created", "market"}
NATION_COLUMNS = {"project", "project_name"}
LINE_COLUMNS = {"issue_type", "assignee", "severity", "labels", "components", "resolved", "updated",
                "has_components", "has_labels"}
# Flags that need no list when the list itself is not asked for.
LIST_FLAGS = {"has_components": {"components", "components_str"},
              "has_labels": {"labels", "labels_str"}}
TEXT_COLUMNS = {"summary", "description", "summary_length", "description_length",
                "has_description"}
DERIVED_INPUTS = {
    "is_resolved": {"status"},
    "is_open": {"status"},
    "is_critical": {"issue_type"},
    "age_days": {"created"},
    "resolution_time_hours": {"created", "resolved"},
    "created_week": {"created"},
    "created_month": {"created"},
    "created_day": {"created"},
    "has_assignee": {"assignee"},
    "components_str": {"components"},
    "labels_str": {"labels"},
}


# Schemas are stated, so opening a table lists files but reads no footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def defects(spark: SparkSession, sf_dir: str, columns: Iterable[str],
            cfg: AnalysisConfig = CONFIG, raw: bool = False,
            orders: DataFrame | None = None) -> DataFrame:
    """One row per order, seen as an issue, with exactly ``columns``.

    ``raw`` leaves missing values missing and derives nothing. ``orders`` may
    replace the order table, for instance by a stream.
    """
    columns = list(columns)
    wanted = set(columns)
    base = set().union(*(DERIVED_INPUTS.get(c, {c}) for c in wanted))
    base -= {flag for flag, lists in LIST_FLAGS.items() if lists & wanted}
    if base & {"resolved", "updated"}:
        base |= {"created", "resolved"}

    df = orders if orders is not None else table(spark, sf_dir, "orders")
    if base & (CUSTOMER_COLUMNS | NATION_COLUMNS):
        df = _join_customer(spark, sf_dir, df, base)
    if base & LINE_COLUMNS:
        df = _join_lines(spark, sf_dir, df, base)
    out = df.select(
        *[rule().alias(name) for name, rule in RULES.items() if name in base],
        F.col("o_orderkey").alias("text_slot"),
    )
    if base & TEXT_COLUMNS:
        out = attach_text(spark, sf_dir, out, base & TEXT_COLUMNS)
    return (out if raw else with_derived(with_defaults(out), cfg, only=wanted)).select(columns)


def _age() -> Column:
    """Days before ``AS_OF``, folded into a per-nation range."""
    raw = F.datediff(F.lit(AS_OF.date()), F.col("o_orderdate").cast("date"))
    return raw % (F.lit(8) * (F.lit(1) + F.col("c_nationkey") % 16))


def _spent() -> Column:
    """Days from creation to resolution."""
    return F.abs(F.datediff(F.col("last_ship").cast("date"), F.col("o_orderdate").cast("date"))) % 15


def _created_day() -> Column:
    return F.date_sub(F.lit(AS_OF.date()), _age())


def _resolved_day() -> Column:
    return F.when((F.col("o_orderstatus") == "F") & (_spent() <= _age()),
                  F.date_add(_created_day(), _spent()))


def _status() -> Column:
    finished = F.element_at(F.array(*map(F.lit, FINISHED_STATUSES)),
                            (F.col("o_orderkey") % 3 + 1).cast("int"))
    return (F.when(F.col("o_orderstatus") == "O", "Open")
            .when(F.col("o_orderstatus") == "P", "In Progress").otherwise(finished))


def _release() -> Column:
    return F.concat(F.lit("REL-"), F.date_format("o_orderdate", "yy"))


RULES: dict[str, Callable[[], Column]] = {
    "key": lambda: F.concat(F.lit("ORD-"), F.col("o_orderkey")),
    "project": lambda: F.col("n_name"),
    "project_name": lambda: F.col("r_name"),
    "issue_type": lambda: F.col("p_type"),
    "status": _status,
    "priority": lambda: _lookup(F.col("o_orderpriority"), PRIORITIES),
    "resolution": lambda: F.when(F.col("o_orderstatus") == "F", "Fixed"),
    "reporter": lambda: F.col("c_name"),
    "assignee": lambda: F.when(F.col("o_orderkey") % 9 != 0, F.col("s_name")),
    "severity": lambda: _lookup(F.col("first_flag"), SEVERITIES),
    "created": lambda: _created_day().cast("timestamp_ntz"),
    "updated": lambda: F.coalesce(_resolved_day(), F.lit(AS_OF.date())).cast("timestamp_ntz"),
    "resolved": lambda: _resolved_day().cast("timestamp_ntz"),
    "components": lambda: F.col("brands"),
    "labels": lambda: F.col("flags"),
    "has_components": lambda: F.coalesce("any_brand", F.lit(False)),
    "has_labels": lambda: F.coalesce("any_flag", F.lit(False)),
    "affected_versions": lambda: F.array(_release()),
    "fix_versions": lambda: F.when(F.col("o_orderstatus") == "F", F.array(_release())),
    "market": lambda: F.col("c_mktsegment"),
    "release_name": _release,
}


def _lookup(value: Column, names: dict[str, str]) -> Column:
    chain = F.lit(None).cast("string")
    for source, name in reversed(names.items()):
        chain = F.when(value == source, name).otherwise(chain)
    return chain


def _join_customer(spark: SparkSession, sf_dir: str, df: DataFrame, base: set[str]) -> DataFrame:
    people = table(spark, sf_dir, "customer")
    if base & NATION_COLUMNS:
        nation = table(spark, sf_dir, "nation")
        if "project_name" in base:
            region = table(spark, sf_dir, "region")
            nation = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
        people = people.join(nation, people.c_nationkey == nation.n_nationkey, "left")
    return df.join(people, F.col("o_custkey") == F.col("c_custkey"), "left")


def _join_lines(spark: SparkSession, sf_dir: str, df: DataFrame, base: set[str]) -> DataFrame:
    """Attach the first line's attributes and the per-order line aggregates.

    The first line is a ``min`` over a struct, so each map task keeps one row
    per order before the shuffle, however many lines an order has. The struct
    ends with the last field wanted, as later ones cannot change that field.
    """
    lines = table(spark, sf_dir, "lineitem")
    first_wanted = base & {"issue_type", "assignee", "severity"}
    with_brand = bool(base & {"components", "has_components"})
    part = table(spark, sf_dir, "part")
    order = ["l_linenumber", "l_partkey"]
    if first_wanted - {"issue_type"}:
        order.append("l_suppkey")
    if "severity" in first_wanted:
        order.append("l_returnflag")
    if with_brand:
        lines = lines.join(part.select("p_partkey", "p_brand", "p_type"),
                           F.col("l_partkey") == F.col("p_partkey"), "left")
        if "issue_type" in base:
            order.append("p_type")
    aggregates = []
    if first_wanted:
        aggregates.append(F.min(F.struct(*order)).alias("first"))
    if base & {"resolved", "updated"}:
        aggregates.append(F.max("l_shipdate").alias("last_ship"))
    if "components" in base:
        aggregates.append(F.array_sort(F.collect_set("p_brand")).alias("brands"))
    if "has_components" in base:
        aggregates.append(F.max(F.col("p_brand").isNotNull()).alias("any_brand"))
    if "has_labels" in base:
        aggregates.append(F.max(F.col("l_returnflag").isNotNull()).alias("any_flag"))
    if "labels" in base:
        aggregates.append(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    per_order = lines.groupBy("l_orderkey").agg(*aggregates)
    df = df.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if not first_wanted:
        return df
    if "severity" in base:
        df = df.withColumn("first_flag", F.col("first.l_returnflag"))
    if "issue_type" in base:
        if with_brand:
            df = df.withColumn("p_type", F.col("first.p_type"))
        else:
            df = df.join(part.select("p_partkey", "p_type"),
                         F.col("first.l_partkey") == F.col("p_partkey"), "left")
    if "assignee" in base:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        df = df.join(supplier, F.col("first.l_suppkey") == F.col("s_suppkey"), "left")
    return df


def _first_line() -> Column:
    return F.substring_index("text", "\n", 1)


TEXT_RULES: dict[str, Callable[[], Column]] = {
    "summary": _first_line,
    "description": lambda: F.col("text"),
    "summary_length": lambda: F.length(_first_line()).cast("bigint"),
    "description_length": lambda: F.length("text").cast("bigint"),
    "has_description": lambda: F.col("text") != "",
}


def _slotted(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    total = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    return df.withColumn("doc_slot", F.col("text_slot") % total)


def _texts(spark: SparkSession, sf_dir: str, columns: Iterable[str]) -> DataFrame:
    wanted = set(columns)
    return table(spark, sf_dir, "documents").select(
        "doc_id", *[rule().alias(c) for c, rule in TEXT_RULES.items() if c in wanted])


def attach_text(spark: SparkSession, sf_dir: str, df: DataFrame,
                columns: Iterable[str] = ("summary",)) -> DataFrame:
    """Join text columns to rows carrying ``text_slot`` (an order number).

    Lengths are taken on the document side, so whole texts are shuffled only
    when a caller wants the texts.
    """
    slotted = _slotted(spark, sf_dir, df)
    return slotted.join(_texts(spark, sf_dir, columns),
                        F.col("doc_slot") == F.col("doc_id"), "left").drop("doc_slot", "doc_id")


def attach_text_to_few(spark: SparkSession, sf_dir: str, df: DataFrame, limit: int,
                       columns: Iterable[str] = ("summary",)) -> DataFrame:
    """The same for the first ``limit`` rows of a short ranking.

    The rows are ranked once and checkpointed. Their slots, at most ``limit``,
    are broadcast to the document scan, so only the matching documents are
    shuffled, whatever the size of the table. For long listings there is
    ``attach_text``.
    """
    checkpoint_root(spark)
    few = _slotted(spark, sf_dir, df.limit(limit)).checkpoint()
    slots = few.select(F.col("doc_slot").alias("doc_id")).distinct()
    texts = _texts(spark, sf_dir, columns).join(F.broadcast(slots), "doc_id", "left_semi")
    return few.join(texts, F.col("doc_slot") == F.col("doc_id"), "left").drop("doc_slot", "doc_id")


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered state changes per issue: the event table seen as a status log."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("ISS-"), F.col("user_id")).alias("key"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("state"),
    )


def issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue, including those without a state change."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("ISS-"), F.col("c_custkey")).alias("key"))


# Fixed value: the state that counts as finished in the event log.
LOG_FINISHED = ("purchase",)


def writeups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels, seen as issue write-ups of varying care."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("label_doc"), "quality", "toxic")
    first_line = _first_line()
    return documents.join(labels, F.col("doc_id") == F.col("label_doc"), "left").select(
        F.concat(F.lit("DOC-"), F.col("doc_id")).alias("key"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("description"),
        F.when(F.col("doc_id") % 7 == 0, F.substring(first_line, 1, 8))
        .otherwise(first_line).alias("summary"),
        F.when(F.col("doc_id") % 4 != 0, F.array("source"))
        .otherwise(F.array().cast("array<string>")).alias("components"),
        F.when(F.col("quality") == 1, "High").when(F.col("quality") == 0, "Low").alias("priority"),
        F.when(F.coalesce(F.col("toxic"), F.lit(0)) != 1, F.col("source")).alias("assignee"),
    )
