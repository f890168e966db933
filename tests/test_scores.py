"""Quantile sketches and the quality of scores, against plain computations."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from issuelens.operators import evaluation, health, sketches

TIMES = "release_name string, created_week string, hours double"


@pytest.fixture(scope="module")
def times(spark):
    draw = random.Random(5)
    rows = [(f"R{draw.randrange(2)}", f"W{draw.randrange(6)}", draw.choice([float(draw.randrange(40)), draw.expovariate(0.01)]))
            for _ in range(6000)]
    rows += [("R0", "W0", None), (None, "W1", 3.0), (None, "W2", 5.0)]
    return rows, spark.createDataFrame(rows, TIMES).cache()


def test_merged_sketches_hold_their_error(times):
    rows, df = times
    parts = sketches.sketches(df, "hours", ["release_name", "created_week"])
    found = sketches.percentiles(parts, ["release_name"])
    far = sketches.rank_distances(df, "hours", found, ["release_name"]).collect()
    assert len(far) == 3 * 4 and all(r.distance <= 2 * sketches.rank_error() for r in far)
    values = {release: sorted(h for r, _, h in rows if r == release and h is not None) for release in ("R0", "R1", None)}
    for r in far:
        own = values[r.release_name]
        low, high = (sum(v < r.estimate for v in own) / len(own), sum(v <= r.estimate for v in own) / len(own))
        assert r.n == len(own) and math.isclose(r.distance, max(low - r.p, r.p - high, 0.0))


def test_sketches_of_all_and_of_nothing(spark, times):
    rows, df = times
    parts = sketches.sketches(df, "hours", ["release_name", "created_week"])
    whole = sketches.percentiles(parts)
    [far] = sketches.rank_distances(df, "hours", whole).groupBy().agg(F.max("distance").alias("d"), F.max("n").alias("n")).collect()
    assert far.n == sum(h is not None for *_, h in rows) and far.d <= 2 * sketches.rank_error()
    assert sketches.percentiles(parts.limit(0)).count() == 0
    assert sketches.sketches(df.limit(0), "hours", ["release_name"]).count() == 0


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("R", "W", float(i)) for i in range(101)], TIMES)
    row = sketches.percentiles(sketches.sketches(df, "hours", ["created_week"])).first()
    assert (row.n, row.p50, row.p90) == (101, 50.0, 90.0)


def test_a_lower_k_has_a_larger_error():
    assert sketches.rank_error(200) > 2 * sketches.rank_error(800) and 0.005 < sketches.rank_error() < 0.006


def test_percentile_names_are_those_of_the_exact_operator(spark):
    assert set(sketches.PERCENTILES) == set(health.PERCENTILES)


def auc(rows):
    positives, negatives = ([s for s, y in rows if y == k] for k in (1, 0))
    if not positives or not negatives:
        return None
    return sum((p > n) + (p == n) / 2 for p in positives for n in negatives) / (len(positives) * len(negatives))


@pytest.mark.parametrize("ranges", [1, 7])
def test_area_equals_all_pairs(spark, monkeypatch, ranges):
    draw = random.Random(ranges)
    rows = [(f"m{draw.randrange(3)}", draw.randrange(20) / 19 if draw.random() < 0.7 else draw.random(), draw.randrange(2))
            for _ in range(400)]
    rows += [("one", 0.5, 1), ("one", 0.7, 1), (None, 0.2, 0), (None, 0.2, 1), ("m0", None, 1), ("m0", 0.3, None)]
    df = spark.createDataFrame(rows, "model string, score double, label int").repartition(3)
    if ranges > 1:
        monkeypatch.setattr(evaluation, "RANGE_SCORES", 30)
    got = {r.model: r.auc for r in evaluation.area_under_curve(df, "score", "label", ["model"]).collect()}
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    want = {m: auc([(s, y) for k, s, y in known if k == m]) for m in {k for k, *_ in known}}
    assert got.keys() == want.keys()
    assert all(got[m] == want[m] if want[m] is None else math.isclose(got[m], want[m]) for m in want)
    [all_] = evaluation.area_under_curve(df, "score", "label").collect()
    assert math.isclose(all_.auc, auc([(s, y) for _, s, y in known]))


def test_accuracy_and_calibration(spark):
    rows = [(0.05, 0), (0.12, 1), (0.5, 1), (0.55, 0), (1.0, 1), (1.2, 1), (-0.1, 0), (None, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    assert tuple(evaluation.accuracy(df, "score", "label").first()) == (7, 5 / 7)
    got = {r.bin: (r.n, r.mean_score, r.positive_share) for r in evaluation.calibration(df, "score", "label").collect()}
    assert got == {0: (2, -0.025, 0.0), 1: (1, 0.12, 1.0), 5: (2, 0.525, 0.5), 9: (2, 1.1, 1.0)}
    empty = df.limit(0)
    assert evaluation.area_under_curve(empty, "score", "label").first().auc is None
    assert evaluation.calibration(empty, "score", "label").count() == 0
    assert tuple(evaluation.accuracy(empty, "score", "label").first()) == (0, None)
