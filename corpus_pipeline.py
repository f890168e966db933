"""The corpus pipeline: five stages over ``documents``.

Low-quality documents go, later copies of lines are cut, lone ones too (copies
of one-line documents are left to the next stage), one document of each
near-duplicate group stays, secrets are masked, and the rest is packed.
Every stage reads all that the one before has kept, from Parquet. Columns other
than the text are passed on; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import line_dedup, minhash_dedup, packing, quality, secret_scan
from issuelens.session import staged

SCORE = "__quality_score"


def _like(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the number of characters of the new text."""
    columns = {c: F.col(c).cast(docs.schema[c].dataType) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return result.select(*[column.alias(name) for name, column in columns.items()])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels), out_col=SCORE)
    return scored.where(F.col(SCORE) >= quality.THRESHOLD).drop(SCORE)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return _like(line_dedup.dedup(docs, run=1, carry=others, copies=False), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(secret_scan.mask(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.piece_digests(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_runs),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scans", secrets),
    ("packing", packed),
]

#: Model scores and token ids are beyond SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
