from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from issuelens.functions.status import finished
from issuelens.operators import reopens, risk

RESOLVED = finished(["Done"])
LOG = "key string, ts timestamp_ntz, seq bigint, state string"


def make_log(n, keys, seed, span_hours=200):
    """A log in which one key owns more than a third of the rows."""
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        key = "HOT" if rng.random() < 0.4 else f"K{rng.randrange(keys)}"
        at = start + timedelta(minutes=rng.randrange(span_hours * 60))
        rows.append((key, at, i, rng.choice(["Open", "Done", "Review"])))
    rng.shuffle(rows)
    return rows


def brute_force(rows):
    counts, last, pairs = {}, {}, {}
    for key, ts, seq, state in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before = last.get(key)
        pairs[(key, seq)] = (before, state)
        counts[key] = counts.get(key, 0) + (before == "Done" and state != "Done")
        last[key] = state
    return counts, last, pairs


@pytest.mark.parametrize("hours", [1, 24, 700])
def test_log_reopens_against_brute_force(spark, hours):
    rows = make_log(1500, 20, seed=1, span_hours=hours)
    counts, last, _ = brute_force(rows)
    got = reopens.log_reopens(spark.createDataFrame(rows, LOG), RESOLVED).collect()
    assert {r["key"]: r["reopen_count"] for r in got} == counts
    assert {r["key"]: r["status"] for r in got} == last


def test_one_issue_holding_one_day_is_dealt_over_all_ranges(spark):
    rows = make_log(6000, 5, seed=6, span_hours=20)
    dealt = reopens._dealt(spark.createDataFrame(rows, LOG))
    hot = [r["count"] for r in dealt.where("key = 'HOT'").groupBy("range").count().collect()]
    assert len(hot) >= 2 and max(hot) <= 6000 / 4 * 1.5
    plan = reopens.log_reopens(spark.createDataFrame(rows, LOG), RESOLVED)._jdf.queryExecution().toString()
    assert "date_trunc" not in plan and "trunctimestamp" not in plan.lower()


def test_pairs_against_brute_force(spark):
    rows = make_log(800, 10, seed=2)
    _, _, pairs = brute_force(rows)
    got = reopens.transition_pairs(spark.createDataFrame(rows, LOG)).collect()
    assert {(r["key"], r["seq"]): (r["from_state"], r["to_state"]) for r in got} == pairs


def test_nested_and_flat_agree(spark):
    rows = make_log(600, 8, seed=3)
    pairs = reopens.transition_pairs(spark.createDataFrame(rows, LOG))
    pages = reopens.nested_changelog(pairs, items_per_page=7)
    assert max(len(r["histories"]) for r in pages.collect()) <= 7
    nested = {r["key"]: r["reopen_count"] for r in reopens.nested_reopens(pages, RESOLVED).collect()}
    flat = {r["key"]: r["reopen_count"] for r in reopens.count_transitions(pairs, RESOLVED).collect()}
    assert nested == flat == brute_force(rows)[0]


def test_issue_without_changes_has_zero(spark):
    issues = spark.createDataFrame([("A",), ("B",)], "key string")
    log = spark.createDataFrame([("A", datetime(2026, 1, 1), 1, "Done"),
                                 ("A", datetime(2026, 1, 2), 2, "Open")], LOG)
    counts = reopens.reopen_counts(issues, log, RESOLVED)
    assert {r["key"]: r["reopen_count"] for r in counts.collect()} == {"A": 1, "B": 0}
    assert [tuple(r) for r in reopens.reopen_summary(counts).collect()] == [(2, 1, 50.0)]
    assert [tuple(r) for r in reopens.reopen_distribution(counts).collect()] == [(1, 1)]
    assert [r["key"] for r in risk.most_reopened(counts, 1).collect()] == ["A"]


def test_null_state_counts_as_unfinished(spark):
    log = spark.createDataFrame([("A", datetime(2026, 1, 1), 1, "Done"),
                                 ("A", datetime(2026, 1, 1, 0, 5), 2, None),
                                 ("A", datetime(2026, 1, 3), 3, "Done"),
                                 ("A", datetime(2026, 1, 9), 4, None)], LOG)
    assert reopens.log_reopens(log, RESOLVED).first()["reopen_count"] == 2


def test_ranges_grow_with_the_log(spark, monkeypatch):
    rows = make_log(300, 6, seed=2)
    log = spark.createDataFrame(rows, LOG)
    monkeypatch.setattr(reopens, "RANGE_ROWS", 20)
    assert reopens._ranges(log) == len(rows) // 20 + 1 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = {r["key"]: r["reopen_count"] for r in reopens.log_reopens(log, RESOLVED).collect()}
    assert counts == brute_force(rows)[0]
    pairs = reopens.transition_pairs(log)
    pages = reopens.nested_changelog(pairs, 4)
    nested = {r["key"]: r["reopen_count"] for r in reopens.nested_reopens(pages, RESOLVED).collect()}
    assert nested == counts
