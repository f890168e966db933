"""Rounding, ratios and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(value: Column, digits: int) -> Column:
    """Round a double half-to-even on its binary value."""
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division giving NULL, not an error, when there is nothing to divide by."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def share(flag: Column) -> Column:
    """Aggregate: fraction of rows for which ``flag`` holds; NULL over no rows."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


def percentage(flag: Column) -> Column:
    """Aggregate: percentage of rows with ``flag``, one decimal, NULL over no rows."""
    return half_even(half_even(share(flag), 6) * 100, 1)


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def band(value: Column, high: float, medium: float,
         labels: tuple[str, str, str] = ("high", "medium", "low")) -> Column:
    """Name of the band: above ``high``, above ``medium``, or the rest (NULL too)."""
    return (F.when(value > high, labels[0]).when(value > medium, labels[1])
            .otherwise(labels[2]))


def clean_non_finite(df: DataFrame, infinities: bool = True) -> DataFrame:
    """NaN (and infinities) to NULL in every floating-point column."""
    def cleaned(name: str) -> Column:
        col = F.col(f"`{name}`")
        bad = F.isnan(col)
        if infinities:
            bad = bad | (F.abs(col) == float("inf"))
        return F.when(~bad, col).alias(name)

    return df.select([
        cleaned(name) if kind in ("double", "float") else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])
