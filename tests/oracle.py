"""Compare a registered query with its SQL twin."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
INTEGERS = {"TINYINT", "SMALLINT", "INTEGER", "BIGINT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(name: str) -> str:
    name = name.upper()
    if name in INTEGERS or name in ("INT", "BIGINT"):
        return "integer"
    return {"STRING": "text", "VARCHAR": "text", "DOUBLE": "double", "BOOLEAN": "boolean"}.get(
        name, name)


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return None if value is None else repr(value)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences found; empty when the results agree exactly."""
    result = con.execute(sql)
    expected_types = {d[0]: _kind(str(d[1])) for d in result.description}
    expected = result.fetchall()
    names = sorted(expected_types)
    actual_types = {n: _kind(t) for n, t in spark_df.dtypes}
    if sorted(actual_types) != names:
        return [f"columns {sorted(actual_types)} != {names}"]
    found = [f"type of {n}: {actual_types[n]} != {expected_types[n]}"
             for n in names if actual_types[n] != expected_types[n]]
    order = [list(expected_types).index(n) for n in names]
    right = sorted(tuple(_cell(row[i]) or "" for i in order) for row in expected)
    left = sorted(tuple(_cell(row[n]) or "" for n in names) for row in spark_df.collect())
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    odd = [(a, b) for a, b in zip(left, right) if a != b]
    if odd:
        found.append(f"{len(odd)} rows differ, first {odd[0]}")
    return found
