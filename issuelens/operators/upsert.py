"""Last write wins, and reads over stored issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuelens.functions.status import STORE_CLOSED, literal_in
from issuelens.operators.releases import in_releases

KEYS = ("key", "release_name")


def _row_hash(rows: DataFrame) -> Column:
    """A hash over all columns that can be hashed (maps and variants cannot)."""
    plain = [f.name for f in rows.schema.fields
             if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    return F.xxhash64(*plain)


def latest(rows: DataFrame, keys: Sequence[str], newest: Sequence[Column | str],
           total: bool = False) -> DataFrame:
    """The newest row per key.

    Rows that are equal in ``newest`` are ordered by a hash of the row, so the
    result does not depend on partitioning; ``total`` says that ``newest``
    already tells any two rows of a key apart. The rank filter runs in each map
    task first, so a key with any number of copies sends one row per task.
    """
    order = [F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in newest]
    if not total:
        order.append(_row_hash(rows).desc())
    ranked = rows.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def missing_key(keys: Sequence[str] = KEYS) -> Column:
    """Why a row cannot be stored; NULL when it can."""
    reason = F.lit(None).cast("string")
    for column in reversed(keys):
        reason = F.when(F.col(column).isNull(), f"no {column}").otherwise(reason)
    return reason


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS,
           newest: Sequence[Column | str] = ("batch_ts",)) -> DataFrame:
    """Old and new rows merged, the newest per (key, release) kept.

    Rows that lack a key cannot be stored; count them with ``rejected``.
    """
    valid = new.where(missing_key(keys).isNull())
    return latest(old.unionByName(valid, allowMissingColumns=True), keys, newest)


def rejected(new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """How many rows an upsert stores and rejects."""
    complete = missing_key(keys).isNull()
    return new.agg(F.count_if(complete).alias("stored"), F.count_if(~complete).alias("skipped"))


def select_defects(defects: DataFrame, registry: DataFrame,
                   releases: Sequence[str] | None = None, status_filter: str = "all",
                   newest: str = "created") -> DataFrame:
    """Stored issues of registered releases, newest first.

    ``status_filter`` is 'open', 'closed' or 'all'; a NULL status is neither
    open nor closed.
    """
    closed = literal_in(STORE_CLOSED)(F.col("status"))
    rows = in_releases(defects, releases) if releases else defects
    if status_filter == "open":
        rows = rows.where(~closed)
    elif status_filter == "closed":
        rows = rows.where(closed)
    elif status_filter != "all":
        raise ValueError(f"unknown status filter: {status_filter}")
    known = registry.select(F.col("name").alias("release_name"))
    return rows.join(known, "release_name").orderBy(F.col(newest).desc_nulls_last(), "key")


def scan_filter(defects: DataFrame, issue_types: Sequence[str], release: str,
                by_severity: bool = False) -> DataFrame:
    """Issues of the defect types affecting ``release``, in search order."""
    order = [F.col("severity").asc_nulls_last()] if by_severity else []
    return defects.where(
        F.col("issue_type").isin(list(issue_types))
        & F.array_contains("affected_versions", release)
    ).orderBy(*order, F.col("created").desc_nulls_last(), "key")


def store_stats(registry: DataFrame, defects: DataFrame, results: DataFrame) -> DataFrame:
    """Row counts of the three tables, as scalars of one row."""
    return registry.agg(F.count_if("is_active").alias("active_releases")).select(
        "active_releases",
        defects.agg(F.count(F.lit(1))).scalar().alias("total_defects"),
        results.agg(F.count(F.lit(1))).scalar().alias("total_analyses"),
    )


def captured(columns: Sequence[str]) -> Column:
    """These columns as one JSON text, missing values included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def raw_json(df: DataFrame) -> DataFrame:
    """Each row captured whole as JSON text beside its key."""
    return df.select("key", captured(df.columns).alias("raw_data"))
