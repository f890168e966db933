"""What counts as finished."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from issuelens.functions.text import strip

# Status sets used by the individual reports.
OPEN_LITERAL = ("Open", "In Progress", "Reopened", "To Do")
STORE_CLOSED = ("Resolved", "Closed", "Done")
WEB_CLOSED = ("Closed", "Resolved")
LITERAL_RESOLVED = ("Resolved",)

StatusTest = Callable[[Column], Column]


def finished(statuses: Iterable[str]) -> StatusTest:
    """Test for a finished status: blanks and case are ignored, NULL is unfinished."""
    names = sorted({s.lower() for s in statuses})

    def test(status: Column) -> Column:
        return F.coalesce(F.lower(strip(status)).isin(names), F.lit(False))

    return test


def literal_in(statuses: Iterable[str]) -> StatusTest:
    """Exact membership; a NULL status is neither in nor out (SQL semantics)."""
    names = list(statuses)
    return lambda status: status.isin(names)


def open_definitions(config_statuses: Iterable[str]) -> dict[str, StatusTest]:
    """Each report's notion of *open*, by name."""
    is_finished = finished(config_statuses)
    return {
        "config": lambda s: ~is_finished(s),
        "literal_resolved": lambda s: ~literal_in(LITERAL_RESOLVED)(s),
        "open_literal": literal_in(OPEN_LITERAL),
        "store_closed": lambda s: ~literal_in(STORE_CLOSED)(s),
        "web_closed": lambda s: ~literal_in(WEB_CLOSED)(s),
    }
