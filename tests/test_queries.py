"""Every registered query against its SQL twin, and checks on the plans."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry_point
import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()
LLM = [n for n in QUERIES if n == "pipeline" or n.startswith("op") and n[2].isdigit()]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_only_a_removed_part_is_left_out():
    def lacking(name):
        def load():
            raise ModuleNotFoundError(name=name)
        return load

    for removed in entry_point.OPTIONAL:
        assert entry_point._optional(lacking(removed)) == ({}, {})
    for broken in ("issuelens.llm.inner", "issuelens.operators", "numpy"):
        with pytest.raises(ModuleNotFoundError):
            entry_point._optional(lacking(broken))


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(ORACLES) - set(LLM)))
def test_matches_oracle(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == []


def test_learned_scores(spark):
    rows = QUERIES["risk_ml"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    assert all(0 <= r["overall_risk_score"] <= 1 for r in rows)
    assert len({r["overall_risk_score"] for r in rows}) > 50


def test_sample_is_reproducible(spark):
    first, again = (QUERIES["pattern_sample"](spark, SF_DIR).collect() for _ in range(2))
    assert sorted(first) == sorted(again) and len(first) == 5


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """Plan as for large tables: nothing is small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


class Plans:
    """Plans of what runs from now on, the writes inside a query included."""

    def __init__(self, spark):
        self.store = spark._jsparkSession.sharedState().statusStore()
        self.last = max((e.executionId() for e in self._executions()), default=-1)

    def _executions(self):
        rows = self.store.executionsList()
        return [rows.apply(i) for i in range(rows.size())]

    def texts(self) -> list[str]:
        return [e.physicalPlanDescription() for e in self._executions() if e.executionId() > self.last]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(LLM)))
def test_plans_scale(shuffled, name):
    """Also of what a query writes and reads again, of model fitting and of streams."""
    plans = Plans(shuffled)
    found = QUERIES[name](shuffled, SF_DIR)
    for plan in [plan_of(found), *plans.texts()]:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "MapInArrow" not in plan and "BatchEvalPython" not in plan


def scanned(*plans: str) -> dict[str, set[str]]:
    """Columns read of each table, from plans in the one-line and in the formatted form."""
    found: dict[str, set[str]] = {}
    for plan in plans:
        scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?/(\w+)\.parquet\]", plan)
        scans += re.findall(r"Scan parquet[^\n]*\nOutput \[\d+\]: \[([^\]]*)\](?:\n[^\n]+)*?"
                            r"\nLocation: [^\n]*/(\w+)\.parquet\]", plan)
        for columns, table in scans:
            names = {re.sub(r"#\d+L?$", "", c.strip()) for c in columns.split(",") if c}
            found.setdefault(table, set()).update(names)
    return found


@pytest.mark.parametrize("name, tables", [
    ("status_definitions", {"orders": {"o_orderkey", "o_orderstatus"}}),
    ("resolved_flag", {"orders": {"o_orderkey", "o_orderstatus"}}),
    ("age_histogram", {"orders": {"o_custkey", "o_orderdate"},
                       "customer": {"c_custkey", "c_nationkey"}}),
    ("severity_profile", {"orders": {"o_orderkey"},
                          "lineitem": {"l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                       "l_returnflag"}}),
    ("reopen_flat", {"customer": {"c_custkey"},
                     "events": {"event_id", "ts", "user_id", "event_type"}}),
])
def test_scans_read_only_what_is_needed(spark, name, tables):
    """Also where a query writes a part and reads it again."""
    plans = Plans(spark)
    found = plan_of(QUERIES[name](spark, SF_DIR))
    assert scanned(found, *plans.texts()) == tables


@pytest.mark.parametrize("name", ["upsert_latest", "release_top_risks"])
def test_rank_filters_run_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert re.search(r"Exchange hashpartitioning(?s:.*)WindowGroupLimit.*Partial", plan)


@pytest.mark.parametrize("name", ["oldest_open", "most_reopened", "project_health_top5",
                                  "assignee_workload", "trend_weekly"])
def test_top_k_is_not_a_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SF_DIR))


def test_shared_counts_are_computed_once(spark):
    df = QUERIES["resolution_percentiles"](spark, SF_DIR)
    df.collect()
    assert "ReusedExchange" in plan_of(df)
