"""Filters, seeded samples, the Pareto frontier, and the pick of plans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave import model
from planweave.session import discard, stored


def hard_filter(metrics: DataFrame, pp_min: float = model.PP_MIN, pop_dev_max: float = model.POP_DEV_MAX) -> DataFrame:
    return metrics.filter((F.col("pp_min") >= pp_min) & (F.col("pop_dev_max") <= pop_dev_max))


def required(rows: DataFrame, what: str = "no plan passes the filter") -> DataFrame:
    if rows.isEmpty():
        raise ValueError(what)
    return rows


def relaxed(rows: DataFrame, count: Column, limits: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Rows within the first limit that lets any through, chosen in one pass over a window of the least count."""
    least = rows.agg(F.min(count).alias("_least"))
    limit = F.lit(None).cast("int")
    for x in reversed(limits):
        limit = F.when(F.col("_least") <= x, x).otherwise(limit)
    return rows.crossJoin(F.broadcast(least)).filter(count <= limit).drop("_least")


def seeded_sample(rows: DataFrame, n: int, key: str = "step", seed: int = model.SEED) -> DataFrame:
    """`n` rows without replacement: those whose seeded digest comes first."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).limit(n)


#: Rows that are compared with the frontier at a time, and tasks whose frontiers meet in one.
ROWS, FAN_IN = 128, 8
#: Rows of a frontier that are sent to all tasks at once.
SENT = 50_000


def _dominated(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Marks of the rows that some row of `by` is nowhere worse than and somewhere better (all columns are to be small)."""
    worse = np.ones((len(rows), len(by)), bool)
    better = np.zeros((len(rows), len(by)), bool)
    for column, other in zip(rows.T, by.T, strict=True):
        worse &= other <= column[:, None]
        better |= other < column[:, None]
    return (worse & better).any(axis=1)


def _skyline(values: np.ndarray) -> np.ndarray:
    """Places of the rows that no row dominates (all columns are to be small). Equal rows stay together."""
    # sorted, a row can only be dominated by one before it
    order = np.lexsort(values.T[::-1])
    kept = np.empty(0, int)
    for at in range(0, len(order), ROWS):
        some = order[at : at + ROWS]
        some = some[~_dominated(values[some], values[kept])]
        kept = np.append(kept, some[~_dominated(values[some], values[some])])
    return kept


def pareto(rows: DataFrame, objectives: dict[str, str]) -> DataFrame:
    """Rows that no other is at least as good as in every objective ("max" or "min") and better in one.

    Objectives that `rows` has no column for are left out; there must be one. Each task
    keeps the frontier of its own rows, and FAN_IN of those meet in a task as long as
    that shrinks them; what is left is compared exactly, SENT rows sent at a time. Equal
    rows all stay.
    """
    objectives = {n: how for n, how in objectives.items() if n in rows.columns}
    names = list(objectives)
    if not names:
        raise ValueError("none of the objectives is a column")
    signs = np.array([-1.0 if objectives[n] == "max" else 1.0 for n in names])

    def local(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            best = frame if best is None else pd.concat([best, frame], ignore_index=True)
            best = best.iloc[_skyline(best[names].to_numpy(float) * signs)]
        if best is not None:
            yield best

    some = stored(rows.mapInPandas(local, rows.schema).withColumn("_task", F.spark_partition_id()), "frontier")
    size, tasks = some.agg(F.count(F.lit(1)), F.countDistinct("_task")).first()
    while tasks > 1:
        together = -(-tasks // FAN_IN)
        if together == 1 and size > SENT:
            break
        met = stored(some.drop("_task").repartition(together).mapInPandas(local, rows.schema).withColumn("_task", F.spark_partition_id()), "frontier")
        left = met.count()
        discard(some)
        some, before, size, tasks = met, size, left, together
        if tasks > 1 and size > 0.9 * before and size > SENT:
            break
    where, some = some.stored_at, some.drop("_task")
    if tasks <= 1:
        some.stored_at = where
        return some
    blocks = -(-size // SENT)
    for i in range(blocks):
        some = _not_dominated(some, some.select(*names).distinct().filter(F.pmod(F.xxhash64(*names), F.lit(blocks)) == i), objectives)
    return some


def _not_dominated(rows: DataFrame, others: DataFrame, objectives: dict[str, str]) -> DataFrame:
    a, b = rows.alias("a"), F.broadcast(others).alias("b")
    as_good = better = None
    for n in objectives:
        less = F.col(f"b.{n}") >= F.col(f"a.{n}") if objectives[n] == "max" else F.col(f"b.{n}") <= F.col(f"a.{n}")
        strict = F.col(f"b.{n}") != F.col(f"a.{n}")
        as_good = less if as_good is None else as_good & less
        better = strict if better is None else better | strict
    return a.join(b, as_good & better, "left_anti")


FIVE = {"pp_mean": "max", "county_splits": "min", "cut_edges": "min", "max_county_districts": "min", "cut_border_m": "min"}
THREE = {"pp_mean": "max", "county_splits": "min", "cut_edges": "min"}


def select_best(frontier: DataFrame) -> DataFrame:
    """choice ('compact', 'splits') and step.

    Plans without a narrow connector are preferred, if there are any; then those with
    the fewest districts in one county; then the most compact, and the one with the
    fewest county splits. Ties go to the lower step.
    """
    mean = F.greatest(F.col("cut_border_m") / F.greatest(F.col("cut_edges"), F.lit(1)), F.lit(1.0))
    marked = frontier.withColumn("wide", (F.col("min_cut_border_m") / mean >= model.PENINSULA_RATIO).cast("int"))
    tiers = marked.groupBy("wide").agg(F.min("max_county_districts").alias("fewest"))
    top = F.broadcast(tiers.orderBy(F.desc("wide")).limit(1))
    group = marked.join(top, (marked["wide"] == top["wide"]) & (marked["max_county_districts"] == top["fewest"]), "left_semi")
    compact = group.orderBy(F.desc("pp_mean"), "step").limit(1).select(F.lit("compact").alias("choice"), "step")
    splits = group.orderBy("county_splits", F.desc("pp_mean"), "step").limit(1).select(F.lit("splits").alias("choice"), "step")
    return compact.union(splits)


def skyline_pair(rows: DataFrame, part: str) -> DataFrame:
    """The frontier of (score up, cost down) within each `part`, by a running least cost over the scores above."""
    best = rows.groupBy(part, "score").agg(F.min("cost").alias("least"))
    above = F.min("least").over(Window.partitionBy(part).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("above", above).filter("above is null or least < above").select(part, "score", F.col("least").alias("cost"))
    return rows.join(best, [part, "score", "cost"], "left_semi")


def _thinned(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's frontiers of (score up, cost down) by stretch: of many rows few are left."""
    for frame in frames:
        frame = frame.sort_values(["stretch", "score", "cost"], ascending=[True, False, True])
        yield frame[frame["cost"] <= frame.groupby("stretch")["cost"].cummin()]


def frontier_growth(metrics: DataFrame, key: str, points: int = 60) -> DataFrame:
    """checkpoint, frontier: the size of the frontier of all rows up to each of at most `points` geometrically spaced keys.

    A row belongs to the first checkpoint that holds it; only what is on the frontier
    of its own stretch can be on a later one, so only those rows go to all later checkpoints.
    """
    last = metrics.agg(F.max(key).cast("double").alias("last"))
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(F.pow("last", i / float(points - 1)) + 1e-9))
    steps = last.select(F.array_sort(F.array_distinct(at)).alias("steps"))
    own = metrics.crossJoin(F.broadcast(steps)).withColumn("stretch", F.array_min(F.filter("steps", lambda c: c >= F.col(key)))).filter("stretch is not null")
    own = own.drop("steps").filter("score is not null and cost is not null")
    local = skyline_pair(own.mapInPandas(_thinned, own.schema), "stretch")
    later = local.crossJoin(F.broadcast(steps)).withColumn("checkpoint", F.explode(F.filter("steps", lambda c: c >= F.col("stretch")))).drop("steps")
    sizes = skyline_pair(later, "checkpoint").groupBy("checkpoint").agg(F.count(F.lit(1)).alias("n"))
    return steps.select(F.explode("steps").alias("checkpoint")).join(sizes, "checkpoint", "left").select("checkpoint", F.coalesce("n", F.lit(0)).alias("frontier"))
