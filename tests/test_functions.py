from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issuelens.functions import changelog, custom_fields, dates, numbers, risk, text, writeup
from issuelens.functions.release_names import release_sequence
from issuelens.functions.status import finished, open_definitions


def column(spark, values, kind, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", rule(F.col("v")).alias("x")).orderBy("i").select(
        "x").collect()]


@pytest.mark.parametrize("current, count, expected", [
    ("TRAIN-41", 3, ["TRAIN-41", "TRAIN-40", "TRAIN-39"]),
    ("2031-03", 4, ["2031-03", "2031-02", "2031-01", "2030-52"]),
    ("W-01", 4, ["W-01", "W-00"]),
    ("7.12", 2, ["7.12", "7.11"]),
    ("Build300", 2, ["Build300", "Build299"]),
    ("v10", 2, ["v10", "v09"]),
    ("Long Term Support", 3, ["Long Term Support"]),
    ("", 2, [""]),
    (None, 2, [None]),
    ("SPRINT-3-14", 2, ["SPRINT-3-14", "SPRINT-3-13"]),
    ("R1-60", 61, [f"R1-{m:02d}" for m in range(60, 0, -1)] + ["R0-52"]),
    ("R00-00", 2, ["R-1-52", "R-1-51"]),
    ("9" * 30, 2, ["9" * 30]),
])
def test_release_sequence(spark, current, count, expected):
    assert column(spark, [current], "string", lambda v: release_sequence(v, count, 52)) == [expected]


def test_release_sequence_needs_a_count(spark):
    with pytest.raises(ValueError):
        release_sequence(F.lit("v1"), 0, 52)


@pytest.mark.parametrize("value, expected", [
    ('{"value": "Blocker"}', "Blocker"),
    ('{"name": "Major"}', "Major"),
    ('{"value": "", "name": "Major"}', "Major"),
    ('"S1"', "S1"),
    ("3", "3"),
    ("null", "Unknown"),
    (None, "Unknown"),
])
def test_option_text(spark, value, expected):
    assert column(spark, [value], "string",
                  lambda v: custom_fields.option_text(F.parse_json(v))) == [expected]


def test_field_id():
    assert custom_fields.field_id("99999") == "customfield_99999"
    assert custom_fields.field_id("customfield_99999") == "customfield_99999"
    assert custom_fields.field_id(" ") == ""


def test_finished_ignores_case_and_blanks(spark):
    values = ["Resolved", " done ", "CLOSED\t", "Open", "", None, "Fixed"]
    test = finished(["Resolved", "Closed", "Done", "Fixed"])
    assert column(spark, values, "string", test) == [True, True, True, False, False, False, True]


def test_open_definitions_on_null_and_unlisted(spark):
    tests = open_definitions(["Done"])
    assert column(spark, [None], "string", tests["config"]) == [True]
    assert column(spark, [None], "string", tests["store_closed"]) == [None]
    assert column(spark, ["Parked"], "string", tests["open_literal"]) == [False]
    assert column(spark, ["Parked"], "string", tests["web_closed"]) == [True]


def test_periods_match_python(spark):
    days = [datetime(1999, 12, 25) + timedelta(days=i) for i in range(0, 4000, 3)]
    weeks = column(spark, days, "timestamp_ntz", dates.week_key)
    assert weeks == [d.strftime("%Y-W%U") for d in days]
    assert column(spark, [days[0], None], "timestamp_ntz", dates.month_key) == ["1999-12", "Unknown"]
    assert column(spark, [None], "timestamp_ntz", dates.week_key) == ["Unknown"]
    assert column(spark, [None], "timestamp_ntz", dates.day_key) == ["Unknown"]


def test_stamps_use_19_characters_and_ignore_the_offset(spark):
    values = ["2026-01-31T10:20:30.000+0900", "2026-01-31T10:20:30", "2026-01-31", "nonsense", None]
    expected = datetime(2026, 1, 31, 10, 20, 30)
    assert column(spark, values, "string", dates.parse_stamp) == [expected, expected, None, None,
                                                                  None]


def test_age_counts_full_days(spark):
    as_of = datetime(2026, 6, 1, 12, 0, 0)
    rng = random.Random(7)
    values = [as_of + timedelta(seconds=rng.randint(-10**8, 10**6)) for _ in range(300)]
    assert column(spark, [*values, None], "timestamp_ntz", lambda v: dates.age_days(v, as_of)) == [
        (as_of - v).days for v in values] + [0]


def test_age_is_independent_of_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # A daylight-saving change lies between the two moments.
        got = column(spark, [datetime(2026, 3, 7, 12, 0)], "timestamp_ntz",
                     lambda v: dates.resolution_hours(v, dates.naive(datetime(2026, 3, 9, 12, 0))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [48.0]


def test_resolution_hours_may_be_negative(spark):
    start = datetime(2026, 1, 2)
    assert column(spark, [datetime(2026, 1, 1, 12), None], "timestamp_ntz",
                  lambda v: dates.resolution_hours(dates.naive(start), v)) == [-12.0, None]


def test_half_even_matches_numpy(spark):
    rng = np.random.default_rng(3)
    values = [0.125, 2.5, 0.375, -0.125, 12.345, *(rng.normal(size=500) * 100)]
    values = [float(v) for v in values]
    assert column(spark, values, "double", lambda v: numbers.half_even(v, 2)) == [
        float(np.round(v, 2)) for v in values]


def test_clean_non_finite(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), "a"), (2, float("inf"), None), (3, 1.5, "c"), (4, None, "d")],
        "i int, x double, s string")
    assert [tuple(r) for r in numbers.clean_non_finite(df).orderBy("i").collect()] == [
        (1, None, "a"), (2, None, None), (3, 1.5, "c"), (4, None, "d")]
    kept = numbers.clean_non_finite(df, infinities=False).orderBy("i").collect()
    assert kept[0]["x"] is None and kept[1]["x"] == float("inf")


@pytest.mark.parametrize("thresholds, expected", [
    (risk.RISK_BANDS_STRICT, ["high", "high", "medium", "low", "low", "low"]),
    (risk.RISK_BANDS_WIDE, ["high", "medium", "low", "low", "low", "low"]),
    (risk.COMPONENT_BANDS_UNIT, ["high", "low", "low", "low", "low", "low"]),
])
def test_bands(spark, thresholds, expected):
    values = [0.9, 0.5, 0.25, 0.2, 0.0, None]
    assert column(spark, values, "double", lambda v: numbers.band(v, *thresholds)) == expected


def test_shorten(spark):
    assert column(spark, ["abcdef", "abc", None], "string", lambda v: text.shorten(v, 3)) == [
        "abc...", "abc", None]
    assert column(spark, ["abc"], "string", lambda v: text.shorten(v, 3, always=True)) == ["abc..."]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=40))
def test_strip_matches_python(spark, values):
    values = [v for v in values if not any(0xD800 <= ord(c) < 0xE000 for c in v)] or [" x "]
    assert column(spark, values, "string", text.strip) == [v.strip() for v in values]


CHANGELOG = ("array<struct<created:string,items:array<struct<field:string,fromString:string,"
             "toString:string>>>>")


def _history(*moves, field="status"):
    return {"created": "2026-01-01T00:00:00.000+0000", "items": [
        {"field": field, "fromString": a, "toString": b} for a, b in moves]}


@pytest.mark.parametrize("histories, expected", [
    (None, 0),
    ([], 0),
    ([{"created": None, "items": None}], 0),
    ([None], 0),
    ([_history(("Resolved", "Reopened"))], 1),
    ([_history(("Resolved", None))], 1),
    ([_history((None, "Open"))], 0),
    ([_history(("Resolved", "Closed"))], 0),
    ([_history(("Closed", "Open"), field="resolution")], 0),
    ([_history(("Closed", "Open"), ("Open", "Done")), _history((" DONE ", "To Do"))], 2),
])
def test_nested_reopens(spark, histories, expected):
    test = finished(["Resolved", "Closed", "Done"])
    assert column(spark, [histories], CHANGELOG,
                  lambda v: changelog.reopen_count(v, test)) == [expected]


def _reference_quality(description, components, priority, assignee, summary):
    checks = [
        ("has_description", bool((description or "").strip())),
        ("description_is_substantial", len((description or "").strip()) >= 60),
        ("has_components", bool(components)),
        ("has_priority", bool(priority)),
        ("has_assignee", assignee not in (None, "", "Unassigned")),
        ("summary_is_specific", len((summary or "").strip()) >= 15),
    ]
    return round(sum(ok for _, ok in checks) / 6 * 100, 1), [n for n, ok in checks if not ok]


def test_writeup_quality_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(
        rng.choice([None, "", "  \n\t", "short", " " * 70, "x" * 60, " " + "y" * 59 + "\n"]),
        rng.choice([None, [], ["api"]]),
        rng.choice([None, "", "High"]),
        rng.choice([None, "", "Unassigned", "ann"]),
        rng.choice([None, "bug", "a" * 15, "\t" + "a" * 14]),
    ) for _ in range(200)]
    names = ["description", "components", "priority", "assignee", "summary"]
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "i int, description string, components array<string>, priority string, "
        "assignee string, summary string")
    checks = writeup.writeup_checks(*map(F.col, names))
    got = df.select("i", writeup.quality_score(checks), writeup.missing_checks(checks)).orderBy(
        "i").collect()
    assert [(r[1], r[2]) for r in got] == [_reference_quality(*r) for r in rows]
