"""Keyed frontiers and thresholds of a stream: the same as over all rows at once, after a query that breaks off too."""

import random

import pytest
from pyspark.sql import functions as F

from planweave.operators import selection
from planweave.streaming import frontier, keyed

SCHEMA = "k string, id long, a double, b long"


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def made(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["x", "y", None, "z"]), i, None if i % 17 == 0 else round(rng.random(), 1), rng.randrange(12)) for i in range(n)]


def batch_frontier(spark, rows):
    out = set()
    for k in {r[0] for r in rows}:
        own = spark.createDataFrame([r for r in rows if r[0] == k and r[2] is not None], SCHEMA)
        out |= {(k, r.id) for r in selection.pareto(own, {"a": "max", "b": "min"}).collect()}
    return out


def test_keyed_frontier_goes_on_after_it_broke_off(spark, tmp_path):
    rows, folder = made(300), str(tmp_path)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = lambda: keyed.keyed_frontier(stream(), "k", "id", {"a": "max", "b": "min"})
    for i in range(0, 200, 50):
        put(spark, rows[i : i + 50], f"{folder}/in")

    def broken(batch_rows, batch):  # the second batch is written, then the query dies before it is marked as done
        batch_rows.write.mode("overwrite").parquet(f"{folder}/front/batch={batch}")
        if batch == 1:
            raise RuntimeError("killed")

    query = found().writeStream.outputMode("update").foreachBatch(broken).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    keyed.write_versions(found(), f"{folder}/front", f"{folder}/check").awaitTermination()
    got = {(r.k, r.id) for r in keyed.newest(spark, f"{folder}/front", "k").collect()}
    assert got == batch_frontier(spark, rows[:200])
    put(spark, [*rows[200:], rows[3], ("new", 999, 0.5, 3), ("x", 1000, 5.0, -1)], f"{folder}/in")  # and more, later: a key's frontier may shrink to a row
    keyed.write_versions(found(), f"{folder}/front", f"{folder}/check").awaitTermination()
    got = [(r.k, r.id) for r in keyed.newest(spark, f"{folder}/front", "k").collect()]
    assert set(got) == batch_frontier(spark, [*rows, ("new", 999, 0.5, 3), ("x", 1000, 5.0, -1)])
    assert ("x", 1000) in got and [k for k, _ in got].count("x") == 1


def test_threshold_is_within_its_rank_error(spark, tmp_path):
    rng, folder = random.Random(2), str(tmp_path)
    values = [rng.random() ** 3 / 5 for _ in range(20_000)]
    spark.createDataFrame([(v,) for v in values] + [(None,)] * 50, "pp_min double").repartition(6).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("pp_min double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = keyed.maintain_threshold(stream, "pp_min", f"{folder}/out", f"{folder}/check", k=1024)
    query.awaitTermination()
    got = frontier.latest(spark, f"{folder}/out", query).first()
    rank = sum(v <= got.p90 for v in values) / len(values)
    assert got.rows == 20_000 and abs(rank - 0.9) < 2.3 / 1024 + 1e-4
    assert got.threshold == max(0.04, min(0.10, 0.95 * got.p90))
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) <= 2  # earlier versions are gone
    limits = spark.createDataFrame([(0.01,), (0.086,), (0.5,)], "p double").select(F.round(keyed.adaptive_threshold(F.col("p")), 4).alias("t"))
    assert [r.t for r in limits.collect()] == [0.04, 0.0817, 0.1]


def test_stream_without_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "pp_min double").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("pp_min double").parquet(f"{folder}/in")
    query = keyed.maintain_threshold(stream, "pp_min", f"{folder}/out", f"{folder}/check")
    query.awaitTermination()
    rows = frontier.latest(spark, f"{folder}/out", query).collect()
    assert not rows or rows[0].threshold is None or rows[0].rows in (None, 0)
