"""Parquet folders dealt into buckets by a key, so that work per key needs no exchange.

Spark keeps a bucket layout in its catalogue only. A folder is therefore
written and read under a name that lives as long as the call: the files carry
their bucket numbers themselves, and nothing is left in the catalogue.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from issuelens.session import SHUFFLES_GO, settings

#: Partitions of a folder are found by listing it, as for any path.
BY_LISTING = {"spark.sql.hive.manageFilesourcePartitions": "false"}


def _name() -> str:
    return f"buckets_{uuid.uuid4().hex}"


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int, partition_by: Sequence[str] = ()) -> None:
    """Replace ``path`` by ``rows``: per partition one file per bucket at most."""
    spark, name = rows.sparkSession, _name()
    writer = (rows.repartition(buckets, key).write.format("parquet").mode("overwrite").option("path", path)
              .option("compression", "zstd").option("partitionOverwriteMode", "static").bucketBy(buckets, key))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with settings(spark, BY_LISTING | SHUFFLES_GO):
        try:
            writer.saveAsTable(name)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def read_buckets(spark: SparkSession, path: str, columns: T.StructType, key: str, buckets: int,
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """What has been written below ``path``; groupings by ``key`` and more read it in place."""
    name = _name()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    partitioned = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
    quoted = path.replace("\\", "\\\\").replace("'", "\\'")
    with settings(spark, BY_LISTING):
        spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet {partitioned} "
                  f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{quoted}'")
        try:
            return spark.table(name)
        finally:
            spark.sql(f"DROP TABLE {name}")
