"""The Pareto frontier of a stream of plan metrics, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from planweave.operators import selection
from planweave.session import discard, removed


def maintain(stream: DataFrame, objectives: dict[str, str], path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there and stops. Each batch joins the last frontier with its own rows and writes version `batch`.

    A batch that runs again reads the version before it and overwrites its own, so the result is exactly-once.
    """

    def fold(rows: DataFrame, batch: int) -> None:
        if batch:
            rows = rows.unionByName(rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{batch - 1}"))
        found = selection.pareto(rows, objectives)
        found.write.mode("overwrite").parquet(f"{path}/{batch}")
        discard(found)
        if batch > 1:  # a batch that runs again reads no further back
            removed(rows.sparkSession, f"{path}/{batch - 2}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, query: StreamingQuery | None = None) -> DataFrame:
    """The frontier after the last batch that was written; a run without new data writes none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()) for f in store.listStatus(where) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    if not done:
        raise ValueError(f"no frontier under {path}")
    return spark.read.parquet(f"{path}/{max(done)}")
