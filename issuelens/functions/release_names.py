"""Predecessors of a release name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two name shapes.
TWO_PART = r"^(.*?)(\d+)-(\d+)$"
ONE_PART = r"^(.*?)(\d+)$"


def _padded(number: Column, like: Column) -> Column:
    """Zero-padded to the width of ``like``; a sign takes part of the width."""
    width = F.length(like)
    digits = F.abs(number).cast("string")
    room = F.when(number < 0, width - 1).otherwise(width)
    body = F.lpad(digits, F.greatest(room, F.length(digits)), F.lit("0"))
    return F.concat(F.when(number < 0, "-").otherwise(""), body)


def release_sequence(current: Column, count: int, releases_per_year: int) -> Column:
    """Array of ``current`` and the releases before it, newest first.

    ``<prefix><major>-<minor>`` counts the minor part down and rolls over into
    the major one; ``<prefix><number>`` counts down to zero; any other name,
    and NULL, stands alone.
    """
    if count < 1:
        raise ValueError("count must be at least 1")
    steps = F.sequence(F.lit(0), F.lit(count - 1))
    prefix, major_text, minor_text = (F.regexp_extract(current, TWO_PART, i) for i in (1, 2, 3))
    major, minor = major_text.try_cast("bigint"), minor_text.try_cast("bigint")

    def two_part(step: Column) -> Column:
        past = step - minor
        rolled = past >= 0
        at_major = F.when(rolled, major - 1 - F.floor(past / releases_per_year)).otherwise(major)
        at_minor = F.when(rolled, releases_per_year - past % releases_per_year).otherwise(
            minor - step)
        return F.concat(prefix, _padded(at_major, major_text), F.lit("-"),
                        _padded(at_minor, minor_text))

    stem, number_text = (F.regexp_extract(current, ONE_PART, i) for i in (1, 2))
    number = number_text.try_cast("bigint")

    def one_part(step: Column) -> Column:
        return F.concat(stem, _padded(number - step, number_text))

    return (
        F.when(major.isNotNull() & minor.isNotNull(), F.transform(steps, two_part))
        .when(number.isNotNull(),
              F.transform(F.filter(steps, lambda s: s <= number), one_part))
        .otherwise(F.array(current))
    )
