"""Release names, registries and comparisons."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.functions.release_names import release_sequence
from issuelens.functions.status import STORE_CLOSED, literal_in


def sequence_rows(currents: DataFrame, column: str, count: int,
                  releases_per_year: int) -> DataFrame:
    """One row per (current, predecessor), position 0 being the current release."""
    names = release_sequence(F.col(column), count, releases_per_year)
    return currents.select(F.col(column), F.posexplode(names).alias("position", "release_name"))


def in_releases(df: DataFrame, releases: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the named releases, given as a literal list or as a frame.

    A literal list prunes partitions of a table laid out by release.
    """
    if isinstance(releases, DataFrame):
        return df.join(releases.select("release_name"), "release_name", "left_semi")
    return df.where(F.col("release_name").isin(list(releases)))


def union_releases(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames; a column missing from one is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def register(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add releases whose name is new; a known name keeps its row.

    Names repeated within ``new`` are added once, with the earliest date.
    """
    firsts = new.groupBy("name").agg(
        F.min(F.struct("created_at", "description", "is_active")).alias("row")
    ).select("name", "row.description", "row.created_at", "row.is_active")
    return existing.unionByName(firsts.join(existing, "name", "left_anti"),
                                allowMissingColumns=True)


def with_counts(registry: DataFrame, defects: DataFrame, active_only: bool = True) -> DataFrame:
    """Registry with total and open counts, newest first, in one join.

    Defects are counted before the join; releases without rows show 0 and a
    NULL status counts as not open.
    """
    is_open = ~literal_in(STORE_CLOSED)(F.col("status"))
    counted = defects.groupBy(F.col("release_name").alias("name")).agg(
        F.count(F.lit(1)).alias("total_defects"), F.count_if(is_open).alias("open_defects"))
    rows = registry.where("is_active") if active_only else registry
    zero = F.lit(0).cast("bigint")
    return rows.join(counted, "name", "left").withColumns({
        "total_defects": F.coalesce("total_defects", zero),
        "open_defects": F.coalesce("open_defects", zero),
    }).orderBy(F.col("created_at").desc(), "name")
