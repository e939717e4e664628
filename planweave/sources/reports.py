"""Frontier tables as CSV and run reports as JSON, written and read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_frontier(frontier: DataFrame, path: str) -> None:
    frontier.write.mode("overwrite").option("header", "true").csv(path)


def read_frontier(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def ensemble_report(metrics: DataFrame, passed: DataFrame, chosen: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row: how many plans there are and passed, the thresholds, and the chosen steps by name."""
    counts = metrics.agg(F.count(F.lit(1)).alias("total_plans")).crossJoin(passed.agg(F.count(F.lit(1)).alias("passed_plans")))
    picks = chosen.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("choice", "step")))).alias("chosen"))
    limits = F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv)) if thresholds else F.create_map()
    return counts.crossJoin(picks).withColumn("thresholds", limits)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All reports under a folder, each with the name of its own; unreadable files are skipped."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("ignoreCorruptFiles", "true").json(path)
    return rows.withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -2))


def inlined_figures(pages: DataFrame, text: str, figures: DataFrame) -> DataFrame:
    """pages (key, text) with markdown images `![caption](name)` as HTML figures that carry the named file's bytes.

    figures: name, content. Pages are split at their images, so any number of them is one equi-join.
    """
    parts = pages.select("key", F.posexplode(F.split(F.col(text), r"(?=!\[[^\]]*\]\([^)]*\))")).alias("at", "part"))
    image = r"(?s)^!\[([^\]]*)\]\(([^)]*)\)(.*)$"
    parts = parts.withColumn("name", F.when(F.col("part").rlike(image), F.regexp_extract("part", image, 2)))
    joined = parts.join(figures.select("name", F.base64("content").alias("data")), "name", "left")
    figure = F.concat(F.lit('<figure><img src="data:image/png;base64,'), F.col("data"), F.lit('"/><figcaption>'), F.regexp_extract("part", image, 1), F.lit("</figcaption></figure>"), F.regexp_extract("part", image, 3))
    done = joined.select("key", "at", F.when(F.col("data").isNotNull(), figure).otherwise(F.col("part")).alias("part"))
    return done.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias(text))
