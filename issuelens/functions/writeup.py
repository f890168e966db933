"""How well an issue was written up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from issuelens.functions.numbers import half_even
from issuelens.functions.text import strip

# Check thresholds.
SUBSTANTIAL_DESCRIPTION = 60
SPECIFIC_SUMMARY = 15
UNASSIGNED = "Unassigned"


def writeup_checks(description: Column, components: Column, priority: Column,
                   assignee: Column, summary: Column) -> dict[str, Column]:
    """The six checks, in report order; each is true or false, never NULL."""
    body = strip(F.coalesce(description, F.lit("")))
    title = strip(F.coalesce(summary, F.lit("")))
    owner = F.coalesce(assignee, F.lit(""))
    return {
        "has_description": F.length(body) > 0,
        "description_is_substantial": F.length(body) >= SUBSTANTIAL_DESCRIPTION,
        "has_components": F.coalesce(F.size(components) > 0, F.lit(False)),
        "has_priority": F.coalesce(priority, F.lit("")) != "",
        "has_assignee": ~owner.isin("", UNASSIGNED),
        "summary_is_specific": F.length(title) >= SPECIFIC_SUMMARY,
    }


def quality_score(checks: dict[str, Column]) -> Column:
    passed = sum((c.cast("int") for c in checks.values()), F.lit(0))
    return half_even(passed / len(checks) * 100, 1)


def missing_checks(checks: dict[str, Column]) -> Column:
    """Names of the failed checks, in report order."""
    named = F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()])
    return F.array_compact(named)
