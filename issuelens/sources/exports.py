"""CSV export of issue frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Columns a CSV file can hold: lists joined, other nested values as JSON."""
    def cell(name: str, kind: str):
        if kind == "array<string>":
            return F.array_join(name, ", ").alias(name)
        if kind.startswith(("array", "map", "struct")):
            return F.to_json(name).alias(name)
        return F.col(name)

    return df.select([cell(n, k) for n, k in df.dtypes])


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """One folder of CSV parts with headers; quotes, blanks and line breaks survive."""
    (flat(df).write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
