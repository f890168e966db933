"""Learned risk: features, encoders, forests, blending, persistence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuelens.config import AnalysisConfig
from issuelens.functions.risk import HIGH_OR_HIGHEST
from issuelens.operators import evaluation
from issuelens.operators.risk import with_fallback_risk
from issuelens.operators.upsert import latest
from issuelens.session import checkpoint_root, read_or_empty, scratch_path, staged

# Encodings, feature lists, blend weights.
ATTENTION_DAYS = 7
AGE_EDGES = (7, 14, 30, 60)
STATUS_CODES = {"Open": 0, "In Progress": 1, "In Review": 2, "Resolved": 3, "Closed": 4}
NO_CRITICAL_TYPES_NORM = 0.25
ENCODED = ("reporter", "assignee", "project", "severity")
MISSING_LABEL = "unknown"
BASE_FEATURES = ("summary_length", "description_length", "has_components", "age_days",
                 "issue_type_severity", "reporter_encoded", "assignee_encoded",
                 "severity_encoded")
EXTRA_FEATURES = ("age_bucket", "status_encoded", "project_encoded", "ai_severity_score",
                  "ai_user_impact")
TARGETS = {"priority": "is_high_priority", "attention": "needs_attention",
           "critical": "is_critical_issue"}
SCORES = {"priority": "priority_risk_score", "attention": "attention_score",
          "critical": "critical_score"}
DEFAULT_SCORE = 0.5
SEVERITY_LEVELS = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
DEFAULT_LEVEL = 0.5
MIN_ROWS, MIN_FEATURES = 10, 3
# Rows the forests are fitted on (expected number), and the buckets these are dealt into.
FIT_ROWS, FIT_BUCKETS = 200_000, 32
# Parts of the hash space that a share is taken of; fine enough for any number of rows.
HASH_PARTS = 1 << 50


def _mapped(value: Column, table: dict, default: Column) -> Column:
    chain = default
    for name, code in table.items():
        chain = F.when(value == name, F.lit(code)).otherwise(chain)
    return chain


def age_bucket(age: Column) -> Column:
    """0..4; day 0 belongs to the first bucket."""
    chain = F.when(age <= AGE_EDGES[0], 0)
    for code, edge in enumerate(AGE_EDGES[1:], 1):
        chain = chain.when(age <= edge, code)
    return chain.otherwise(len(AGE_EDGES))


def type_weight(issue_type: Column, critical_types: Sequence[str]) -> Column:
    """The i-th critical type weighs n+1-i, every other type 1."""
    weights = {name: float(len(critical_types) + 1 - i) for i, name in enumerate(critical_types)}
    return _mapped(issue_type, weights, F.lit(1.0))


def with_features(df: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Targets and row-level features; flags are 0/1."""
    critical = list(cfg.critical_issue_types)
    weight = type_weight(F.col("issue_type"), critical)
    high = F.coalesce(F.col("priority").isin(list(HIGH_OR_HIGHEST)), F.lit(False))
    unresolved = F.coalesce(F.col("status") != "Resolved", F.lit(True))
    return df.withColumns({
        "is_high_priority": high.cast("int"),
        "is_critical_issue": F.col("is_critical").cast("int"),
        "needs_attention": ((F.col("age_days") > ATTENTION_DAYS) & unresolved).cast("int"),
        "has_components": F.col("has_components").cast("int"),
        "age_bucket": age_bucket(F.col("age_days")),
        "status_encoded": _mapped(F.col("status"), STATUS_CODES, F.lit(0)),
        "issue_type_severity": weight,
        "issue_type_severity_norm": (
            weight / (len(critical) + 1) if critical else F.lit(NO_CRITICAL_TYPES_NORM)),
    })


@dataclass(frozen=True)
class Labels:
    """A written label table (``field, value, code, version``), one folder per field.

    It only ever grows: a later version adds values with the next codes, and
    what an earlier version says of a value stays. ``version`` is the last one
    that is looked at, all of them by default. Reading one field's folder lets
    the optimizer see that field's true size, so short tables are broadcast and
    long ones shuffled.
    """

    spark: SparkSession
    path: str
    version: int | None = None

    def _seen(self, rows: DataFrame) -> DataFrame:
        return rows if self.version is None else rows.where(F.col("version") <= self.version)

    def table(self) -> DataFrame:
        columns = "value string, code bigint, field string, version int"
        return self._seen(self.spark.read.schema(columns).parquet(self.path))

    def codes(self, name: str) -> DataFrame:
        columns = "value string, code bigint, version int"
        return self._seen(read_or_empty(self.spark, f"{self.path}/field={name}", columns)).select("value", "code")

    def save(self, path: str) -> Labels:
        self.table().write.mode("overwrite").partitionBy("field", "version").parquet(path)
        return Labels(self.spark, path, self.version)


def _field_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The different values per field, a missing one among them."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"),
                 F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)).alias("value"))
        for c in columns
    ])
    return df.select(F.inline(pairs)).distinct()


def _ranked_values(values: DataFrame) -> DataFrame:
    """(value, code, field): the rank of a value among the sorted ones of its field, from 0.

    Ranking is distributed: values are range-partitioned and sorted, ranked
    inside their partition, and shifted by the number of values in the
    partitions before it. The partitioning is checkpointed first, so a lost
    executor cannot re-cut the ranges between counting and ranking.
    """
    checkpoint_root(values.sparkSession)
    placed = (values.repartitionByRange("field", "value")
              .withColumn("part", F.spark_partition_id()).checkpoint())
    before = Window.partitionBy("field").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = placed.groupBy("field", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "field", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("field", "part").orderBy("value")
    return (placed.withColumn("rank", F.row_number().over(within))
            .join(shifts, ["field", "part"])
            .select("value", (F.col("shift") + F.col("rank") - 1).alias("code"), "field"))


def fit_labels(df: DataFrame, columns: Sequence[str] = ENCODED) -> Labels:
    """Label table in which codes rank the sorted distinct values of a column."""
    path = scratch_path(df.sparkSession, "labels")
    (_ranked_values(_field_values(df, columns)).withColumn("version", F.lit(0))
     .write.partitionBy("field", "version").parquet(path))
    return Labels(df.sparkSession, path)


def extend_labels(labels: Labels, df: DataFrame, columns: Sequence[str] = ENCODED) -> Labels:
    """The label table with the values of ``df`` that it lacks, as its next version.

    New values rank among themselves behind all old ones, whose codes stay, so
    a model that was fitted on an earlier version scores old and new rows alike.
    Without new values nothing is written.
    """
    known = labels.table()
    last = known.agg(F.max("version")).first()[0]
    lacking = _field_values(df, columns).join(known.select("field", "value"), ["field", "value"], "left_anti")
    sizes = known.groupBy("field").agg((F.max("code") + 1).alias("size"))
    added = _ranked_values(lacking).join(sizes, "field", "left").select(
        "value", (F.col("code") + F.coalesce("size", F.lit(0))).alias("code"), "field")
    added = staged(added, "new-labels")
    if added.isEmpty():
        return labels
    version = 0 if last is None else last + 1
    # a version that was broken off is written anew, and no other is touched
    (added.withColumn("version", F.lit(version)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("field", "version").parquet(labels.path))
    return Labels(labels.spark, labels.path, version)


def encode(df: DataFrame, labels: Labels, columns: Sequence[str] = ENCODED) -> DataFrame:
    """Add ``<column>_encoded``. A value the table has not seen gets the next
    free code, so a trained model's inputs are never re-coded."""
    out = df
    for name in columns:
        target = f"{name}_encoded"
        if name not in df.columns:
            out = out.withColumn(target, F.lit(0).cast("bigint"))
            continue
        codes = labels.codes(name).select(
            F.col("value").alias("_value"), F.col("code").alias("_code"))
        unseen = codes.agg(F.count(F.lit(1))).scalar()
        value = F.coalesce(F.col(name).cast("string"), F.lit(MISSING_LABEL))
        out = out.join(codes, value == F.col("_value"), "left").withColumn(
            target, F.coalesce("_code", unseen)).drop("_value", "_code")
    return out


def level_score(level: Column) -> Column:
    return _mapped(level, SEVERITY_LEVELS, F.lit(DEFAULT_LEVEL))


def impact_score(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return (F.when(lowered.contains("severe") | lowered.contains("critical"), 1.0)
            .when(lowered.contains("moderate"), 0.5).otherwise(0.25))


def with_enrichment(df: DataFrame, enrichment: DataFrame, newest: Sequence[str] = ("created_at",)) -> DataFrame:
    """Join per-key assessments (``key, level, user_impact``) as scores; rows
    without one take the median of those that have.

    Of several assessments of a key the newest counts, by those of the
    ``newest`` columns that there are. Medians come from counts per pair of
    scores, of which there are a handful.
    """
    names = ("ai_severity_score", "ai_user_impact")
    enrichment = latest(enrichment, ["key"], [c for c in newest if c in enrichment.columns])
    scored = enrichment.select(
        "key",
        level_score(F.col("level")).alias(names[0]),
        impact_score(F.col("user_impact")).alias(names[1]),
    )
    counts = (scored.join(df.select("key"), "key", "left_semi").groupBy(*names)
              .agg(F.count(F.lit(1)).alias("n")))
    medians = counts.agg(F.struct(*[
        F.percentile(name, F.lit(0.5), F.col("n")).alias(name) for name in names
    ])).scalar()
    joined = df.join(scored, "key", "left").withColumn("_medians", medians)
    return joined.withColumns({
        name: F.coalesce(F.col(name), F.col(f"_medians.{name}")) for name in names
    }).drop("_medians")


def blend(df: DataFrame, name: str = "overall_risk_score", enriched: bool | None = None) -> DataFrame:
    """Weighted blend of the model scores and the issue-type weight."""
    if enriched is None:
        enriched = "ai_severity_score" in df.columns
    c = F.col
    if enriched:
        score = (c("priority_risk_score") * 0.3 + c("attention_score") * 0.2
                 + c("critical_score") * 0.2 + c("ai_severity_score") * 0.2
                 + c("issue_type_severity_norm") * 0.1)
    else:
        score = (c("priority_risk_score") * 0.4 + c("attention_score") * 0.3
                 + c("issue_type_severity_norm") * 0.3)
    return df.withColumn(name, score)


@dataclass
class RiskModels:
    """Fitted forests, or a constant score where the target had one class only."""

    labels: Labels | None
    features: tuple[str, ...] = ()
    forests: dict[str, RandomForestClassificationModel] = field(default_factory=dict)
    constants: dict[str, float] = field(default_factory=dict)
    accuracy: dict[str, float] = field(default_factory=dict)

    @property
    def trained(self) -> bool:
        return bool(self.forests or self.constants)


def available_features(df: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in (*BASE_FEATURES, *EXTRA_FEATURES) if c in df.columns)


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    # Codes are plain numbers here: no nominal metadata, so trees need no extra bins.
    numbers = df.withColumns({
        f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    vectors = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features")
    return vectors.transform(numbers).drop(*[f"_f_{c}" for c in features])


def _fitting_rows(rows: DataFrame, fit_rows: int, seed: int) -> DataFrame:
    """About ``fit_rows`` rows at most, chosen by a hash of the key, in a fixed layout.

    Bagging follows partitions and the order inside them. So rows are dealt
    into a fixed number of buckets of the key, sorted, and checkpointed in that
    state: the forests are the same on any cluster.
    """
    checkpoint_root(rows.sparkSession)
    share = min(1.0, fit_rows / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(HASH_PARTS)) < int(share * HASH_PARTS))
    order = F.xxhash64(*[c for c in rows.columns if c != "features"])
    return chosen.repartition(FIT_BUCKETS, "key").sortWithinPartitions("key", order).checkpoint()


def held_out(seed: int = 42) -> Column:
    """The fifth of the issues that forests are never fitted on."""
    return F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(5)) == 0


def model_quality(df: DataFrame, models: RiskModels, seed: int = 42) -> DataFrame:
    """Per model: accuracy and area under the curve over the issues it was not fitted on."""
    scored = staged(predict(df.where(held_out(seed)), models).select(*SCORES.values(), *TARGETS.values()), "held-out")
    long = scored.select(F.explode(F.array(*[F.struct(
        F.lit(name).alias("model"), F.col(score).cast("double").alias("score"),
        F.col(TARGETS[name]).cast("int").alias("label")) for name, score in SCORES.items()])).alias("of")).select("of.*")
    right = evaluation.accuracy(long, "score", "label", ["model"])
    area = evaluation.area_under_curve(long, "score", "label", ["model"])
    return right.join(area, "model").select("model", "n", "positives", "accuracy", "auc")


def train(df: DataFrame, labels: Labels | None = None, trees: int = 100, max_depth: int = 5,
          seed: int = 42, evaluate: bool = False, fit_rows: int = FIT_ROWS) -> RiskModels:
    """Fit the three forests on four fifths of at most about ``fit_rows`` rows.

    The split is by a hash of the key, so it does not move when a partition is
    recomputed. With too few rows or features nothing is trained.
    """
    features = available_features(df)
    fitted = RiskModels(labels=labels, features=features)
    if len(features) < MIN_FEATURES:
        return fitted
    wanted = [(target, t) for target, t in TARGETS.items() if t in df.columns]
    rows = _assembled(df, features).select(
        "key", "features", *[F.col(t).cast("double").alias(t) for _, t in wanted],
        (~held_out(seed)).alias("training"))
    rows = _fitting_rows(rows, fit_rows, seed)
    size = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("training").alias("n"),
        *[F.sum(F.when(F.col("training"), F.col(t))).alias(t) for _, t in wanted]).first()
    if size["total"] < MIN_ROWS or not size["n"]:
        return fitted
    training = rows.where("training")
    for name, target in wanted:
        if size[target] in (0.0, float(size["n"])):
            fitted.constants[name] = 1.0 if size[target] else 0.0
            continue
        forest = RandomForestClassifier(
            labelCol=target, featuresCol="features", numTrees=trees, maxDepth=max_depth, seed=seed)
        fitted.forests[name] = forest.fit(training)
        if evaluate:
            checked = fitted.forests[name].transform(rows.where("NOT training"))
            fitted.accuracy[name] = checked.agg(
                F.avg((F.col("prediction") == F.col(target)).cast("int"))).first()[0]
    return fitted


def predict(df: DataFrame, models: RiskModels) -> DataFrame:
    """Add the model scores and their blend; untrained models give the fallback score."""
    features = available_features(df)
    if not models.trained or len(features) < MIN_FEATURES:
        return with_fallback_risk(df)
    out = _assembled(df, models.features)
    for name, score in SCORES.items():
        if name in models.forests:
            model = models.forests[name].copy()
            for setter in (model.setRawPredictionCol, model.setPredictionCol):
                setter("")
            model.setProbabilityCol("_probability")
            out = model.transform(out).withColumn(
                score, vector_to_array("_probability")[1]).drop("_probability")
        else:
            out = out.withColumn(score, F.lit(models.constants.get(name, DEFAULT_SCORE)))
    return blend(out.drop("features"))


def prepare(df: DataFrame, cfg: AnalysisConfig, labels: Labels | None = None,
            enrichment: DataFrame | None = None) -> tuple[DataFrame, Labels]:
    """Feature frame and its label table; the input is evaluated once."""
    df = staged(df, "issues")
    rows = with_features(df, cfg)
    if enrichment is not None:
        rows = with_enrichment(rows, enrichment)
    if labels is None:
        labels = fit_labels(df, [c for c in ENCODED if c in df.columns])
    return staged(encode(rows, labels), "features"), labels


def score_risks(df: DataFrame, cfg: AnalysisConfig, enrichment: DataFrame | None = None,
                **settings) -> DataFrame:
    """Prepare, train and score in one go."""
    rows, labels = prepare(df, cfg, enrichment=enrichment)
    return predict(rows, train(rows, labels, **settings))


def save_models(models: RiskModels, path: str) -> None:
    """Forests, label table and constants under one folder."""
    spark = SparkSession.active()
    for name, model in models.forests.items():
        model.write().overwrite().save(f"{path}/{name}_model")
    if models.labels is not None:
        models.labels.save(f"{path}/labels")
    facts = [("feature", c, float(i)) for i, c in enumerate(models.features)]
    facts += [("constant", n, v) for n, v in models.constants.items()]
    facts += [("forest", n, 1.0) for n in models.forests]
    spark.createDataFrame(facts, "kind string, name string, value double").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/settings")


def load_models(spark: SparkSession, path: str) -> RiskModels:
    facts = spark.read.parquet(f"{path}/settings").orderBy("kind", "value").collect()
    return RiskModels(
        labels=Labels(spark, f"{path}/labels"),
        features=tuple(r["name"] for r in facts if r["kind"] == "feature"),
        forests={r["name"]: RandomForestClassificationModel.load(f"{path}/{r['name']}_model")
                 for r in facts if r["kind"] == "forest"},
        constants={r["name"]: r["value"] for r in facts if r["kind"] == "constant"},
    )
