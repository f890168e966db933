from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from issuelens.operators import ml, risk
from issuelens.operators.derive import with_derived
from issuelens.plans import analysis
from issuelens.sources.store import DefectStore

ROWS = ("key string, project string, issue_type string, priority string, status string, "
        "severity string, reporter string, assignee string, summary string, description string, "
        "components array<string>, created timestamp_ntz, age_days bigint, release_name string")


@pytest.fixture(scope="module")
def issues(spark, cfg):
    rng = random.Random(21)
    rows = []
    for i in range(160):
        kind = rng.choice(["Bug", "Critical Bug"])
        rows.append((
            f"K-{i}", rng.choice("PQRS"), kind,
            "High" if kind == "Critical Bug" and rng.random() < 0.8 else "Low",
            rng.choice(["Open", "Resolved", "In Review", "Parked"]),
            rng.choice(["S1", "S2", None]), rng.choice(["ann", "Bob", "zoe", None]),
            rng.choice(["ann", "Unassigned"]), "s" * rng.randint(3, 50), "d" * rng.randint(0, 300),
            ["api"] if rng.random() < 0.5 else [], None, rng.randint(0, 90), "R1"))
    return with_derived(spark.createDataFrame(rows, ROWS), cfg).cache()


@pytest.mark.parametrize("age, bucket", [
    (0, 0), (7, 0), (8, 1), (14, 1), (15, 2), (30, 2), (31, 3), (60, 3), (61, 4), (9999, 4)])
def test_age_bucket(spark, age, bucket):
    assert spark.range(1).select(ml.age_bucket(F.lit(age))).first()[0] == bucket


def test_type_weights(spark, cfg):
    df = spark.createDataFrame([("A",), ("B",), ("C",), ("other",), (None,)], "t string")
    got = [r[0] for r in df.select(ml.type_weight(F.col("t"), ["A", "B", "C"])).collect()]
    assert got == [4.0, 3.0, 2.0, 1.0, 1.0]


def test_weight_is_normalised_to_one(issues, cfg):
    five = replace(cfg, critical_issue_types=("Critical Bug", "b", "c", "d", "e"))
    got = ml.with_features(issues, five).agg(F.max("issue_type_severity_norm")).first()[0]
    assert got == 1.0
    none = replace(cfg, critical_issue_types=())
    assert {r[0] for r in ml.with_features(issues, none).select(
        "issue_type_severity_norm").collect()} == {0.25}


def test_status_codes(issues, cfg):
    got = {(r["status"], r["status_encoded"])
           for r in ml.with_features(issues, cfg).collect()}
    assert got == {("Open", 0), ("Resolved", 3), ("In Review", 2), ("Parked", 0)}


def test_labels_rank_sorted_values(spark, issues):
    labels = ml.fit_labels(issues, ["reporter", "severity"])
    got = {(r["field"], r["value"]): r["code"] for r in labels.table().collect()}
    expected = {("reporter", v): i for i, v in enumerate(sorted(["ann", "Bob", "zoe", "unknown"]))}
    expected |= {("severity", v): i for i, v in enumerate(["S1", "S2", "unknown"])}
    assert got == expected


def test_labels_over_many_values(spark):
    values = sorted({f"{random.Random(i).random():.9f}" for i in range(3000)})
    df = spark.createDataFrame([(v,) for v in values * 2], "reporter string")
    got = {r["value"]: r["code"] for r in ml.fit_labels(df, ["reporter"]).table().collect()}
    assert got == {v: i for i, v in enumerate(values)}


def test_unseen_values_do_not_move_known_codes(spark, issues):
    labels = ml.fit_labels(issues, ["reporter"])
    new = spark.createDataFrame([("ann",), ("new",), (None,)], "reporter string")
    got = {r["reporter"]: r["reporter_encoded"]
           for r in ml.encode(new, labels, ["reporter", "project"]).collect()}
    assert got == {"ann": 1, "new": 4, None: 2}
    assert ml.encode(new, labels, ["project"]).first()["project_encoded"] == 0


def test_codes_never_move(spark, tmp_path):
    columns = "reporter string, severity string"
    first = spark.createDataFrame([("mo", "S2"), ("bo", "S1"), (None, "S1")], columns)
    second = spark.createDataFrame([("al", "S1"), ("mo", "S3"), ("zo", None), ("al", "S1")], columns)
    labels = ml.fit_labels(first, ["reporter", "severity"])
    old = {(r.field, r.value): r.code for r in labels.table().collect()}
    grown = ml.extend_labels(labels, second, ["reporter", "severity"])
    new = {(r.field, r.value): r.code for r in grown.table().collect()}
    assert old.items() <= new.items() and grown.version == 1
    assert {k: v for k, v in new.items() if k not in old} == {
        ("reporter", "al"): 3, ("reporter", "zo"): 4, ("severity", "S3"): 2, ("severity", "unknown"): 3}
    assert ml.extend_labels(grown, second, ["reporter", "severity"]) == grown
    before = ml.Labels(spark, labels.path, 0)
    assert {(r.field, r.value): r.code for r in before.table().collect()} == old
    assert ml.encode(second, before, ["reporter"]).where("reporter = 'al'").first()["reporter_encoded"] == 3
    saved = grown.save(str(tmp_path / "labels"))
    assert {(r.field, r.value): r.code for r in saved.table().collect()} == new
    third = ml.extend_labels(grown, spark.createDataFrame([("aa", "S9")], columns), ["reporter", "severity"])
    assert {r.value: r.code for r in third.codes("reporter").collect()}["aa"] == 5 and third.version == 2
    # a version that is written again replaces itself alone
    again = ml.extend_labels(ml.Labels(spark, labels.path, 1), spark.createDataFrame([("aa", "S9")], columns),
                             ["reporter", "severity"])
    assert again.table().count() == third.table().count() == len(new) + 2


def test_a_saved_model_scores_new_values_alike(spark, issues, cfg, tmp_path):
    rows, labels = ml.prepare(issues, cfg)
    models = ml.train(rows, labels, trees=5)
    before = {r.key: r.overall_risk_score for r in ml.predict(rows, models).collect()}
    fresh = issues.limit(3).withColumns({"key": F.concat(F.lit("new-"), "key"), "reporter": F.lit("aaa"), "assignee": F.lit("aab")})
    grown = ml.extend_labels(labels, fresh)
    both, _ = ml.prepare(issues.unionByName(fresh), cfg, labels=grown)
    after = {r.key: r.overall_risk_score for r in ml.predict(both, models).collect()}
    assert len(after) == len(before) + 3 and all(after[k] == v for k, v in before.items())


def test_a_field_without_labels_encodes_as_unseen(spark, issues):
    labels = ml.fit_labels(issues.limit(0), ["reporter"])
    assert ml.encode(issues, labels, ["reporter"]).first()["reporter_encoded"] == 0


def test_enrichment_fills_with_the_median(spark):
    keys = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "key string")
    given = spark.createDataFrame(
        [("A", "critical", "Severe outage"), ("B", "low", "moderate pain"),
         ("X", "critical", "critical"), ("C", "odd", None)],
        "key string, level string, user_impact string")
    got = {r["key"]: (r["ai_severity_score"], r["ai_user_impact"])
           for r in ml.with_enrichment(keys, given).collect()}
    assert got == {"A": (1.0, 1.0), "B": (0.25, 0.5), "C": (0.5, 0.25), "D": (0.5, 0.5)}


@pytest.fixture(scope="module")
def trained(issues, cfg):
    rows, labels = ml.prepare(issues, cfg)
    return rows, ml.train(rows, labels, trees=20, evaluate=True)


def test_scores_are_probabilities_and_rank_sensibly(trained):
    rows, models = trained
    scored = ml.predict(rows, models)
    got = scored.collect()
    for name in (*ml.SCORES.values(), "overall_risk_score"):
        assert all(0.0 <= r[name] <= 1.0 for r in got)
    high = [r["priority_risk_score"] for r in got if r["is_high_priority"]]
    low = [r["priority_risk_score"] for r in got if not r["is_high_priority"]]
    assert sum(high) / len(high) > sum(low) / len(low) + 0.2
    assert models.accuracy["critical"] > 0.9
    top = risk.top_risks(scored, 5, "overall_risk_score").collect()
    assert top[0]["overall_risk_score"] == max(r["overall_risk_score"] for r in got)


def test_training_is_repeatable(trained):
    rows, models = trained
    again = ml.train(rows, models.labels, trees=20)
    pick = ["key", *ml.SCORES.values()]
    first = sorted(map(tuple, ml.predict(rows, models).select(pick).collect()))
    assert first == sorted(map(tuple, ml.predict(rows, again).select(pick).collect()))


def test_scores_do_not_follow_the_cluster(spark, issues, cfg):
    pick = ["key", *ml.SCORES.values()]
    outcome = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            rows, labels = ml.prepare(issues.repartition(partitions), cfg)
            scored = ml.predict(rows, ml.train(rows, labels, trees=8))
            outcome.append(sorted(map(tuple, scored.select(pick).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert outcome[0] == outcome[1]


def test_fitting_rows_are_bounded_and_all_rows_scored(trained):
    rows, models = trained
    small = ml.train(rows, models.labels, trees=5, fit_rows=60)
    assert small.trained and ml.predict(rows, small).count() == rows.count()


def test_the_newest_assessment_counts_once(spark):
    keys = spark.createDataFrame([("A",), ("B",)], "key string")
    given = spark.createDataFrame([("A", "low", None, 1), ("A", "critical", None, 2), ("A", "low", None, 0)],
                                  "key string, level string, user_impact string, created_at int")
    got = {r["key"]: r["ai_severity_score"] for r in ml.with_enrichment(keys, given).collect()}
    assert got == {"A": 1.0, "B": 1.0} and ml.with_enrichment(keys, given).count() == 2


def test_save_and_load(spark, trained, tmp_path):
    rows, models = trained
    ml.save_models(models, str(tmp_path / "m"))
    ml.save_models(models, str(tmp_path / "m"))
    loaded = ml.load_models(spark, str(tmp_path / "m"))
    assert loaded.features == models.features and set(loaded.forests) == set(models.forests)
    pick = ["key", "overall_risk_score"]
    assert sorted(map(tuple, ml.predict(rows, loaded).select(pick).collect())) == sorted(
        map(tuple, ml.predict(rows, models).select(pick).collect()))


def test_one_class_targets_score_their_label(issues, cfg):
    rows, labels = ml.prepare(issues.where("issue_type = 'Bug'").withColumn(
        "priority", F.lit("High")), cfg)
    models = ml.train(rows, labels, trees=5)
    assert models.constants == {"priority": 1.0, "critical": 0.0}
    got = ml.predict(rows, models).first()
    assert (got["priority_risk_score"], got["critical_score"]) == (1.0, 0.0)


def test_too_few_rows_fall_back(issues, cfg):
    rows, labels = ml.prepare(issues.limit(9), cfg)
    models = ml.train(rows, labels)
    assert not models.trained
    got = {r["key"]: r["overall_risk_score"] for r in ml.predict(rows, models).collect()}
    assert got == {r["key"]: r["overall_risk_score"]
                   for r in risk.with_fallback_risk(rows).collect()}


def test_a_missing_model_scores_half(trained):
    rows, models = trained
    partial = replace(models, forests={k: v for k, v in models.forests.items() if k != "attention"})
    assert ml.predict(rows, partial).first()["attention_score"] == 0.5


def test_enriched_training_uses_the_assessments(spark, issues, cfg):
    given = issues.select("key", F.lit("critical").alias("level"),
                          F.lit("moderate").alias("user_impact")).limit(20)
    rows, labels = ml.prepare(issues, cfg, enrichment=given)
    models = ml.train(rows, labels, trees=5)
    assert {"ai_severity_score", "ai_user_impact"} <= set(models.features)
    got = ml.predict(rows, models).first()
    expected = (got["priority_risk_score"] * 0.3 + got["attention_score"] * 0.2
                + got["critical_score"] * 0.2 + got["ai_severity_score"] * 0.2
                + got["issue_type_severity_norm"] * 0.1)
    assert got["overall_risk_score"] == pytest.approx(expected)


def test_predictions_are_stored(spark, trained, tmp_path):
    rows, models = trained
    store = DefectStore(spark, str(tmp_path / "store"))
    scored = ml.predict(rows, models)
    store.store_predictions(scored.select("key", "release_name", "overall_risk_score"),
                            "forest", "overall_risk_score")
    assert store.predictions().count() == 160
    assert store.predictions().first()["model_type"] == "forest"


def test_learned_ranking_in_the_full_analysis(issues, cfg):
    base = analysis.analysis_base(issues, cfg)
    parts = analysis.comprehensive_analysis(base, cfg, learned=True, trees=5)
    got = [r["risk_score"] for r in parts["top_risks"].collect()]
    assert len(got) == 25 and got == sorted(got, reverse=True)
