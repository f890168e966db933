from datetime import datetime

import pytest

from issuelens.session import check_shared, scratch_path
from issuelens.config import AnalysisConfig, parse_field_map, parse_list

NOW = datetime(2026, 6, 1)


@pytest.mark.parametrize("text, expected", [
    ("app_version=customfield_101,os_version=customfield_102",
     {"app_version": "customfield_101", "os_version": "customfield_102"}),
    (" app_version = customfield_101 ", {"app_version": "customfield_101"}),
    ("", {}),
    (None, {}),
    ("garbage,app_version=customfield_101", {"app_version": "customfield_101"}),
    ("odd=a=b", {"odd": "a=b"}),
])
def test_field_map(text, expected):
    assert parse_field_map(text) == expected


def test_lists():
    assert parse_list("Bug, Defect ,Incident") == ("Bug", "Defect", "Incident")
    assert parse_list("Bug,,Defect") == ("Bug", "Defect")


def test_defaults():
    cfg = AnalysisConfig.from_settings({}, NOW)
    assert cfg.defect_issue_types == ("Bug",)
    assert cfg.critical_issue_types == ()
    assert cfg.resolved_statuses == ("Resolved", "Closed", "Done", "Fixed")
    assert cfg.severity_field == "" and cfg.releases_per_year == 52


def test_settings():
    cfg = AnalysisConfig.from_settings(
        {"SEVERITY_FIELD": "99999", "CURRENT_RELEASE": "REL-25", "RELEASES_PER_YEAR": "26"}, NOW)
    assert cfg.severity_field == "99999"
    assert cfg.default_releases == ("REL-25",) and cfg.releases_per_year == 26


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    for root in ("file:///tmp/x", "file:/x", "/tmp/x"):
        with pytest.raises(RuntimeError):
            check_shared(root, one_machine=False)
        check_shared(root, one_machine=True)
        check_shared(root, one_machine=False, mounted=True)
    check_shared("hdfs://nn/x", one_machine=False)
    check_shared("/user/x", one_machine=False)


def test_scratch_has_one_parent_per_application(spark):
    first, second = scratch_path(spark, "a"), scratch_path(spark, "b")
    parent = first.rsplit("/", 1)[0]
    assert second.startswith(parent) and spark.sparkContext.applicationId in parent
