"""A corpus from raw documents to packed sequences, one operator a stage.

Every stage works on all that the one before kept and is written and read again, so a
lost executor costs at most one stage. A null text counts as empty; repeated rows
pass the classifiers as they are and fall to one in the near-dedup stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm import packing, quality, secrets, simhash, toxicity
from planweave.llm.common import table
from planweave.session import discard, shared_folder, until_exit

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade is at least quality.KEEP."""
    model = quality.fitted(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.scored(docs.select(*COLUMNS), model, whole=True).filter(quality.best_tail() >= quality.KEEP).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under toxicity.THRESHOLD."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(toxicity.split_of("doc_id", 3) != 1)
    weights = toxicity.train(*toxicity.labelled_texts(docs, labels, "toxic"))
    return toxicity.scored(docs.select(*COLUMNS), weights, whole=True).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates."""
    return simhash.first_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span that the scan finds masked."""
    found = secrets.scan(docs.select(*COLUMNS), into="_found")
    clean = F.when(F.size("_found") > 0, secrets.masked(F.col("text"), F.col("_found"))).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.size("_found") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.report(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]
#: Models and fingerprints aren't SQL's to express; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; a stage's table goes once the next one is written, the last when the session ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/planweave-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        until_exit(spark, path)
        discard(docs)
        docs = spark.read.parquet(path)
        docs.stored_at = path
    return docs
