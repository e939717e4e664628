"""Frontiers of a stream, one a key, kept in the state store; and a threshold that follows the stream's quantiles.

A key's state is its frontier: rows that a new one dominates are dropped as it comes in, so
the state is no larger than the frontier. After every batch the keys that changed are
written with their version; the newest of each key is the result, whichever batch ran
twice. A query that is stopped or killed goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planweave.operators.selection import _dominated, _skyline
from planweave.session import qualified, removed

#: Kept of a quantile sketch: the larger, the smaller its rank error (about 2.3 / k for this kind; exact below k rows).
SKETCH = 4096
# Fixed values of the adaptive filter: its least and largest threshold, the quantile and the share of it.
FLOOR, BASE, QUANTILE, SHARE = 0.04, 0.10, 0.90, 0.95


def keyed_frontier(stream: DataFrame, key: str, row: str, objectives: dict[str, str]) -> DataFrame:
    """key, version, row, and the objectives: the whole frontier of every key that a batch changed.

    Equal rows all stay. `row` is a number that names a row; objectives are numbers, "max" or "min".
    """
    names, signs = list(objectives), np.array([-1.0 if how == "max" else 1.0 for how in objectives.values()])
    kinds = stream.select(key, row, *names).dtypes
    columns = ", ".join(f"{n} {kind}" for n, kind in kinds)
    state_schema = "version long, rows array<long>, " + ", ".join(f"{n} array<double>" for n in names)
    whole = dict(kinds)

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, rows, *lists = state.get if state.exists else (0, [], *([] for _ in names))
        ids, values = np.array(rows, np.int64), np.array(lists, float).T.reshape(-1, len(names))
        changed = False
        for frame in frames:
            frame = frame.dropna(subset=names)
            new, new_ids = frame[names].to_numpy(float), frame[row].to_numpy(np.int64)
            best = _skyline(new * signs)
            new, new_ids = new[best], new_ids[best]
            kept = ~_dominated(new * signs, values * signs) if len(values) else np.ones(len(new), bool)
            if kept.any():
                new, new_ids, changed = new[kept], new_ids[kept], True
                still = ~_dominated(values * signs, new * signs) if len(values) else np.zeros(0, bool)
                ids, values = np.concatenate([ids[still], new_ids]), np.concatenate([values[still], new])
        if changed:
            version += 1
            state.update((version, ids.tolist(), *(values[:, i].tolist() for i in range(len(names)))))
            out = {key: group[0], "version": version, row: ids} | {n: values[:, i].astype("int64") if whole[n] in ("bigint", "int") else values[:, i] for i, n in enumerate(names)}
            yield pd.DataFrame(out)

    out = f"{key} {whole[key]}, version long, " + columns.partition(", ")[2]
    return stream.select(key, row, *names).groupBy(key).applyInPandasWithState(fold, out, state_schema, "update", GroupStateTimeout.NoTimeout)


def write_versions(frontiers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there and stops; each batch has a folder, which a second run of it writes over."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return frontiers.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Every key's frontier of its last version."""
    rows = spark.read.parquet(qualified(spark, path)).drop("batch")
    last = F.max("version").over(Window.partitionBy(key))
    return rows.withColumn("_last", last).filter("version = _last").drop("_last", "version")


def adaptive_threshold(quantile: Column) -> Column:
    """The least compactness that a plan may have, by the plans' own 90th percentile."""
    return F.greatest(F.lit(FLOOR), F.least(F.lit(BASE), SHARE * quantile))


def sketched(rows: DataFrame, value: str, k: int = SKETCH) -> DataFrame:
    """One row: a sketch of the values' quantiles, which merges with others; null values don't count."""
    return rows.agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def maintain_threshold(stream: DataFrame, value: str, path: str, checkpoint: str, k: int = SKETCH) -> StreamingQuery:
    """Every batch merges its sketch into the one before it and writes version `batch` of it, with the threshold; versions before the last two go."""

    def fold(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        sketches = sketched(rows.filter(F.col(value).isNotNull()), value, k)
        if batch:
            sketches = sketches.unionByName(spark.read.parquet(f"{path}/{batch - 1}").select("sketch"))
        merged = sketches.filter("sketch is not null").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
        found = merged.withColumn("rows", F.kll_sketch_get_n_double("sketch")).withColumn("p90", F.when(F.col("rows") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(QUANTILE))))
        found.withColumn("threshold", adaptive_threshold(F.col("p90"))).coalesce(1).write.mode("overwrite").parquet(f"{path}/{batch}")
        if batch > 1:
            removed(spark, f"{path}/{batch - 2}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
