"""The first rows of a ranking, overall or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_rows(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in this order, of each group of ``by`` when given.

    Both forms keep no more than ``n`` rows per group and task before a shuffle.
    """
    if not by:
        return df.orderBy(*order).limit(n)
    within = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= n)
    return ranked.orderBy(*by, "_place").drop("_place")
