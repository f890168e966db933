"""The registered queries of the package against their SQL."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from issuelens.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_agrees_with_its_sql(spark, con, name):
    assert compare(LLM_QUERIES[name](spark, SF), con, LLM_ORACLES[name]) == []


@pytest.mark.parametrize("number", range(1, 14))
def test_every_operator_has_one_query(number):
    assert len([n for n in LLM_QUERIES if n.startswith(f"op{number}_")]) == 1


def test_the_native_scan_runs_no_python(spark):
    plan = LLM_QUERIES["op10_secret_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
