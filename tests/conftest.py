from __future__ import annotations

from datetime import datetime

import pytest

from issuelens.config import AnalysisConfig
from issuelens.operators.derive import with_derived
from issuelens.session import build_session

AS_OF = datetime(2026, 6, 1)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[4]", shuffle_partitions=4,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cfg():
    return AnalysisConfig(as_of=AS_OF, critical_issue_types=("Critical Bug",),
                          severity_field="99999",
                          custom_fields={"app_version": "customfield_101"})


QUICK = ("key string, project string, summary string, issue_type string, priority string, "
         "status string, severity string, age_days bigint, assignee string, release_name string")
QUICK_ROWS = [
    ("PAY-7", "PAY", "refund differs by a cent", "Bug", "Highest", "Open", "Minor", 6, "noor", "REL-31"),
    ("PAY-9", "PAY", "card form freezes", "Critical Bug", "High", "Open", "Major", 77, "noor", "REL-31"),
    ("MAP-2", "MAP", "tiles are fetched twice", "Bug", "Low", "In Progress", "Minor", 33, "Unassigned",
     "REL-31"),
    ("MAP-4", "MAP", "route is gone after a restart", "Bug", "High", "Done", "Major", 13, "ivo", "REL-31"),
    ("MAP-5", "MAP", "legend is cut off", "Bug", "Medium", "Closed", "Unknown", 95, "ivo", "REL-31"),
    ("API-1", "API", "timeouts under load", "Critical Bug", "Medium", "Done", "Major", 28, "mei", "REL-31"),
]
RESOLVED_ROW = QUICK_ROWS[3]


@pytest.fixture
def frame(spark, cfg):
    """Build a derived frame from quick rows (all by default)."""
    def make(rows=None):
        from pyspark.sql import functions as F

        rows = QUICK_ROWS if rows is None else rows
        base = spark.createDataFrame(rows, QUICK)
        created = F.expr("cast(timestamp_ntz'2026-06-01 00:00:00' - make_interval(0, 0, 0, "
                         "cast(age_days as int)) as timestamp_ntz)")
        return with_derived(base.withColumn("created", created), cfg)
    return make


@pytest.fixture
def summary_frame(spark):
    """The frame of the comprehensive summary, from keyword overrides."""
    schema = ("project string, is_resolved boolean, is_critical boolean, age_days double, "
              "assignee string, priority string, has_components boolean, "
              "resolution_time_hours double")
    base = {"project": "BILLING", "is_resolved": True, "is_critical": False, "age_days": 9.0,
            "assignee": "dana", "priority": "Low", "has_components": False,
            "resolution_time_hours": 30.0}

    def make(*overrides):
        rows = [tuple((base | o).values()) for o in overrides]
        return spark.createDataFrame(rows, schema)
    return make
