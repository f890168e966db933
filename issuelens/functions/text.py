"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of the characters a whitespace strip removes.
WHITESPACE = "".join(map(chr, (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203),
    8232, 8233, 8239, 8287, 12288,
)))


def strip(value: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(value, F.lit(WHITESPACE))


def shorten(value: Column, width: int, always: bool = False) -> Column:
    """First ``width`` characters and an ellipsis; short text stays as it is
    unless ``always``."""
    cut = F.concat(F.substring(value, 1, width), F.lit("..."))
    return cut if always else F.when(F.length(value) > width, cut).otherwise(value)


def joined(names: Column) -> Column:
    return F.array_join(names, ", ")
