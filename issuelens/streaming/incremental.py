"""Counts that a stream keeps up to date, at the cost of what has changed.

State is held in RocksDB and kept for good: there is no watermark,
so rows may land in any order, again, or years late. What a landing changes is
filed per batch, and a batch that is run again replaces what it had filed, so a
query that is stopped anywhere goes on from its checkpoint without counting
twice.

* Reopens are a plain aggregation: transitions are immutable facts, each counts
  once, and the totals are read from the state itself.
* Daily counts need retraction: an issue whose newest version has another day
  leaves the old day and enters the new one. A landing files the differences
  per release and day, and a total is their sum. Issues share a row of state
  by slots, so a landing of n rows reads n slots at most, and writes those with
  a newer version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from issuelens.functions.dates import micros
from issuelens.functions.status import StatusTest
from issuelens.operators.reopens import count_transitions
from issuelens.operators.trends import running_total
from issuelens.session import ROCKSDB, read_or_empty, settings

BATCH = "batch"
TRANSITION_KEY = ("key", "ts", "seq")
ISSUE_KEY = ("key", "release_name")
#: Issues are dealt by hash into so many slots, since a call into Python and a row of state cost more than
#: the issue in it. The number holds for the life of a checkpoint.
SLOTS = 1 << 15
#: Stand for an absent day and an absent version; no date or time is as early.
NO_DAY, NO_VERSION = -(2**31), -(2**63)
CHANGES = "release_name string, day date, n bigint"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # a commit uploads what it changed, not the whole state
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _filed(changes: DataFrame, path: str, checkpoint: str,
           folded: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """File what ``folded`` makes of each batch's changes; a batch that is run again is replaced."""
    def write(batch: DataFrame, batch_id: int) -> None:
        folded(batch).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id:012d}")

    # a query takes its settings when it starts
    with settings(changes.sparkSession, STATE_STORE):
        return (changes.writeStream.outputMode("update").foreachBatch(write)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# Reopens


def follow_reopens(transitions: DataFrame, is_resolved: StatusTest, path: str, checkpoint: str) -> StreamingQuery:
    """Count reopens per issue over a stream of transitions (``key, ts, seq, from_state, to_state``).

    A transition is known by ``TRANSITION_KEY``, so one that lands again counts
    once. Every batch files the issues it touched, with their new counts.
    """
    return _filed(count_transitions(transitions.dropDuplicates(list(TRANSITION_KEY)), is_resolved), path, checkpoint)


def reopen_totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, reopen_count) of every issue seen so far, read from the state of ``follow_reopens``."""
    state = spark.read.format("statestore").option("operatorId", 0).load(checkpoint)
    count = state.schema["value"].dataType.fieldNames()[0]
    return state.select(F.col("key.key").alias("key"), F.col(f"value.`{count}`").alias("reopen_count"))


def reopen_changes(spark: SparkSession, path: str) -> DataFrame:
    """(batch, key, reopen_count): what each batch changed."""
    return read_or_empty(spark, path, f"key string, reopen_count bigint, {BATCH} string")


# Daily counts


def _day_moves():
    """The days that the issues of a slot leave and enter; nothing where an outdated version lands.

    The inner function goes to the executors by value, so this package need not
    be installed there.
    """
    def moved(key, frames, state):
        import pickle
        from collections import Counter

        import pandas as pd

        known = pickle.loads(state.get[0]) if state.exists else {}
        moves, changed = Counter(), False
        for f in frames:
            for name, release, *version in zip(*(f[c].tolist() for c in (*ISSUE_KEY, "version", "day"))):
                newest, of_release = tuple(version), known.setdefault(release, {})
                old = of_release.get(name)
                if old is None or newest > old:
                    of_release[name], changed = newest, True
                    moves[release, newest[1]] += 1
                    if old is not None:
                        moves[release, old[1]] -= 1
        if changed:
            state.update((pickle.dumps(known, protocol=4),))
        rows = [(release, day, n) for (release, day), n in moves.items() if n and day != NO_DAY]
        if rows:
            release, day, n = zip(*rows)
            yield pd.DataFrame({"release_name": release, "day": pd.array(day, "int32"), "n": pd.array(n, "int64")})

    return moved


def follow_daily_counts(issues: DataFrame, path: str, checkpoint: str, version: str = "updated") -> StreamingQuery:
    """Follow the day of every issue over a stream of versions (``key, release_name, created``).

    The greatest ``version`` of a (key, release) counts, the latest day of equal
    ones; a missing version is older than any other, and a version without
    ``created`` is on no day. Every batch files (release, day, difference).
    """
    stamp = F.coalesce(micros(F.col(version), issues.schema[version].dataType), F.lit(NO_VERSION))
    day = F.coalesce(F.unix_date(F.col("created").cast("date")), F.lit(NO_DAY))
    slot = F.pmod(F.xxhash64(*ISSUE_KEY), F.lit(SLOTS)).cast("int")
    versions = issues.select(slot.alias("slot"), *ISSUE_KEY, stamp.alias("version"), day.alias("day"))
    moved = versions.groupBy("slot").applyInPandasWithState(
        _day_moves(), "release_name string, day int, n bigint", "newest binary",
        "update", GroupStateTimeout.NoTimeout)

    def folded(batch: DataFrame) -> DataFrame:
        return batch.groupBy("release_name", F.date_from_unix_date("day").alias("day")).agg(
            F.sum("n").alias("n")).where("n <> 0")

    return _filed(moved, path, checkpoint, folded)


def daily_totals(spark: SparkSession, path: str) -> DataFrame:
    """Discoveries per release and day with running totals, from the filed differences.

    One row per release, day and batch is read, however many issues there are.
    """
    changes = read_or_empty(spark, path, CHANGES)
    daily = changes.groupBy("release_name", "day").agg(F.sum("n").alias("daily_count")).where("daily_count <> 0")
    return running_total(daily).orderBy("release_name", "day")


def compact_changes(spark: SparkSession, path: str, target: str) -> None:
    """Write the totals of ``path`` as the first batch of ``target``.

    A stopped query goes on from its checkpoint into ``target``; its next
    batches have greater numbers.
    """
    changes = read_or_empty(spark, path, CHANGES)
    (changes.groupBy("release_name", "day").agg(F.sum("n").alias("n")).where("n <> 0")
     .write.mode("overwrite").parquet(f"{target}/{BATCH}=compact"))


def landed_rows(query: StreamingQuery) -> Sequence[tuple[int, int]]:
    """(rows read, rows of state written) per batch of a query that has run."""
    return [(p["numInputRows"], sum(op["numRowsUpdated"] for op in p["stateOperators"]))
            for p in query.recentProgress if p["numInputRows"]]
