"""Transparent risk scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from issuelens.functions.numbers import clip01, half_even

# Weights and band thresholds.
CRITICAL_WEIGHT, PRIORITY_WEIGHT, AGE_WEIGHT, OPEN_WEIGHT = 0.3, 0.2, 0.3, 0.2
AGE_CAP_DAYS = 30
HIGH_ONLY = ("High",)
HIGH_OR_HIGHEST = ("High", "Highest")
RISK_BANDS_STRICT = (0.3, 0.2)
RISK_BANDS_WIDE = (0.7, 0.4)
HEALTH_BANDS = (0.7, 0.5)
COMPONENT_BANDS_TEN = (7, 4)
COMPONENT_BANDS_UNIT = (0.8, 0.6)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def linear_risk(is_critical: Column, priority: Column, age_days: Column, is_resolved: Column,
                high: Iterable[str] = HIGH_ONLY, digits: int | None = None) -> Column:
    """Weighted sum of critical type, high priority, capped age and being open."""
    score = (
        _flag(is_critical) * CRITICAL_WEIGHT
        + _flag(priority.isin(list(high))) * PRIORITY_WEIGHT
        + clip01(age_days / AGE_CAP_DAYS) * AGE_WEIGHT
        + _flag(~is_resolved) * OPEN_WEIGHT
    )
    return score if digits is None else half_even(score, digits)


def fallback_risk(is_critical: Column, priority: Column, age_days: Column,
                  is_resolved: Column) -> Column:
    """The score used while no model is trained."""
    return linear_risk(is_critical, priority, age_days, is_resolved, high=HIGH_OR_HIGHEST)
