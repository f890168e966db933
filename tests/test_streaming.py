from __future__ import annotations

from datetime import date, datetime, timedelta
from pathlib import Path
from random import Random

import pytest
from pyspark.sql import functions as F

from issuelens.functions.status import finished
from issuelens.operators import reopens, trends
from issuelens.session import ROCKSDB
from issuelens.streaming import incremental
from test_reopens import LOG, RESOLVED, brute_force, make_log

VERSIONS = "key string, release_name string, created timestamp_ntz, updated timestamp_ntz"


class Followed:
    """A folder that rows land in, and a stream that follows it from its checkpoint."""

    def __init__(self, spark, root, schema, follow, name="followed"):
        self.spark, self.schema, self.follow = spark, schema, follow
        self.source, self.changes, self.log = (str(root / f"{name}-{part}") for part in ("in", "changes", "log"))

    def land(self, rows):
        """Land rows, start a new query from the checkpoint, and return its batches' work."""
        rows.write.mode("append").parquet(self.source)
        return self.go_on()

    def go_on(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 2).parquet(self.source)
        query = self.follow(stream, self.changes, self.log)
        query.awaitTermination()
        return incremental.landed_rows(query)


@pytest.fixture
def daily(spark, tmp_path):
    return Followed(spark, tmp_path, VERSIONS, incremental.follow_daily_counts)


@pytest.fixture
def counted(spark, tmp_path):
    schema = "key string, ts timestamp, seq bigint, from_state string, to_state string"
    return Followed(spark, tmp_path, schema, lambda rows, changes, log: incremental.follow_reopens(
        rows, RESOLVED, changes, log), "counted")


def current(versions):
    """The newest version of each issue."""
    best = {}
    for key, release, created, updated in versions:
        found = (updated or datetime.min, created.date() if created else date.min, created)
        best[key, release] = max(best.get((key, release), found), found, key=lambda v: v[:2])
    return [(*identity, created, None) for identity, (_, _, created) in best.items()]


def versions(draw, n=300):
    start = datetime(2026, 1, 1)
    return [(f"K{draw.randrange(400)}", f"R{draw.randrange(2)}",
             start + timedelta(hours=draw.randrange(500)) if draw.random() > 0.1 else None,
             start + timedelta(minutes=draw.randrange(2000)) if draw.random() > 0.1 else None) for _ in range(n)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_daily_counts_equal_the_batch_after_each_landing(spark, daily, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        draw, landed = Random(3), []
        for _ in range(5):
            rows = versions(draw)
            landed += rows
            daily.land(spark.createDataFrame(rows, VERSIONS))
            expected = trends.trendline(spark.createDataFrame(current(landed), VERSIONS)).collect()
            assert incremental.daily_totals(spark, daily.changes).collect() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_an_issue_leaves_its_old_day(spark, daily):
    stamp = lambda day: datetime(2026, 1, day, 23, 30)
    landings = [
        ([("A", "R", stamp(1), stamp(1)), ("B", "R", stamp(1), stamp(1))], {1: 2}),
        ([("A", "R", stamp(2), stamp(2))], {1: 1, 2: 1}),
        ([("A", "R", stamp(3), stamp(1)), ("B", "R", None, stamp(2))], {2: 1}),   # outdated; on no day any more
        ([("A", "R", stamp(2), stamp(2)), (None, "R", stamp(2), None)], {2: 2}),  # again; without a key or a stamp
        ([("B", None, stamp(4), stamp(4)), ("B", "R", stamp(4), stamp(3))], {2: 2, 4: 2}),
    ]
    for rows, expected in landings:
        daily.land(spark.createDataFrame(rows, VERSIONS))
        totals = incremental.daily_totals(spark, daily.changes).groupBy("day").agg(F.sum("daily_count").alias("n"))
        assert {r.day.day: r.n for r in totals.collect()} == expected


def test_a_landing_costs_its_own_rows(spark, daily, counted):
    many = [(f"K{i}", "R", datetime(2026, 1, 1 + i % 9), datetime(2026, 1, 1)) for i in range(500)]
    daily.land(spark.createDataFrame(many, VERSIONS))
    small = spark.createDataFrame([("K1", "R", datetime(2026, 2, 1), datetime(2026, 1, 2))], VERSIONS)
    assert daily.land(small) == [(1, 1)]
    last = spark.read.parquet(daily.changes).orderBy(F.desc("batch")).limit(2).collect()
    assert sorted((r.day, r.n) for r in last) == [(date(2026, 1, 2), -1), (date(2026, 2, 1), 1)]
    pairs = reopens.transition_pairs(spark.createDataFrame(make_log(300, 6, seed=4), LOG)).cache()
    counted.land(pairs.where("seq > 5"))
    read, written = map(sum, zip(*counted.land(pairs.where("seq <= 5"))))
    assert read == pairs.where("seq <= 5").count() and written <= 2 * read
    assert counted.land(pairs.where("seq <= 5"))[0][1] == 0


def test_reopens_equal_batch_with_late_repeated_and_equal_stamps(spark, counted):
    rows = make_log(400, 6, seed=9)
    start = datetime(2026, 1, 1)
    rows += [("SAME", start, 1000 + i, ["Done", "Open"][i % 2]) for i in range(6)]
    pairs = reopens.transition_pairs(spark.createDataFrame(rows, LOG)).cache()
    late = F.dayofmonth("ts") < 5
    for part in (pairs.where(~late), pairs.where(late), pairs.where("seq % 3 = 0")):
        counted.land(part.select([F.col(n).cast(t) for n, t in (
            ("key", "string"), ("ts", "timestamp"), ("seq", "bigint"), ("from_state", "string"),
            ("to_state", "string"))]))
    got = {r["key"]: r["reopen_count"] for r in incremental.reopen_totals(spark, counted.log).collect()}
    assert got == brute_force(rows)[0] and got["SAME"] == 3
    newest = incremental.reopen_changes(spark, counted.changes).groupBy("key").agg(
        F.max_by("reopen_count", "batch").alias("n"))
    assert {r.key: r.n for r in newest.collect()} == got


def test_a_batch_that_runs_again_counts_once(spark, tmp_path, daily):
    """The query stops after filing a batch and before noting that it is done."""
    daily.land(spark.createDataFrame([("A", "R", datetime(2026, 1, 1), None)], VERSIONS))
    daily.land(spark.createDataFrame([("B", "R", datetime(2026, 1, 1), None)], VERSIONS))
    commits = sorted((p for p in (tmp_path / "followed-log" / "commits").iterdir() if p.name.isdigit()),
                     key=lambda p: int(p.name))
    for stale in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        stale.unlink(missing_ok=True)
    assert daily.go_on()
    assert incremental.daily_totals(spark, daily.changes).first()["daily_count"] == 2


def test_compacted_changes_go_on(spark, tmp_path, daily):
    daily.land(spark.createDataFrame([("A", "R", datetime(2026, 1, 1), None)], VERSIONS))
    daily.land(spark.createDataFrame([("A", "R", datetime(2026, 1, 2), datetime(2026, 1, 1))], VERSIONS))
    small = str(tmp_path / "small")
    incremental.compact_changes(spark, daily.changes, small)
    assert spark.read.parquet(small).count() == 1
    daily.changes = small
    daily.land(spark.createDataFrame([("B", "R", datetime(2026, 1, 2), None)], VERSIONS))
    assert [(r.day.day, r.daily_count) for r in incremental.daily_totals(spark, small).collect()] == [(2, 2)]


def test_nothing_landed(spark, tmp_path):
    assert incremental.daily_totals(spark, str(tmp_path / "none")).count() == 0
    assert incremental.reopen_changes(spark, str(tmp_path / "none")).count() == 0


def test_state_is_kept_in_rocksdb(spark, daily):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        daily.land(spark.createDataFrame([("A", "R", datetime(2026, 1, 1), None)], VERSIONS))
        assert spark.conf.get(name).endswith("HDFSBackedStateStoreProvider")
        assert ROCKSDB in Path(daily.log, "offsets", "0").read_text()
    finally:
        spark.conf.set(name, before)


def test_custom_resolved_test(spark):
    rows = [("A", datetime(2026, 1, 1), 1, "Shipped"), ("A", datetime(2026, 1, 2), 2, "Open")]
    log = spark.createDataFrame(rows, LOG)
    assert reopens.log_reopens(log, finished(["shipped"])).first()["reopen_count"] == 1


def test_issues_share_slots_of_state(spark, daily, monkeypatch):
    monkeypatch.setattr(incremental, "SLOTS", 3)
    draw, landed = Random(5), []
    for _ in range(3):
        rows = [(draw.choice([key, None, ""]) if draw.random() < 0.1 else key,
                 None if draw.random() < 0.1 else release, *stamps) for key, release, *stamps in versions(draw)]
        landed += rows
        for read, written in daily.land(spark.createDataFrame(rows, VERSIONS)):
            assert written <= 3
        expected = trends.trendline(spark.createDataFrame(current(landed), VERSIONS)).collect()
        assert incremental.daily_totals(spark, daily.changes).collect() == expected
    again = spark.createDataFrame(landed, VERSIONS)
    assert all(written == 0 for _, written in daily.land(again))
