"""Audits after the fact: votes, swing, seats, bands, diversity, and the tables behind figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave import model
from planweave.functions import scalar


def uniform_swing(votes: DataFrame, targets: DataFrame, state: str = "state") -> DataFrame:
    """votes (state, d, r, ...) with total, share and its estimate after the state's swing to its target share."""
    whole = Window.partitionBy(state)
    d, r = F.coalesce("d", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    rows = votes.withColumn("total", d + r).withColumn("share", scalar.ratio(d, d + r, 0.5))
    rows = rows.withColumn("swing", F.col("target") - scalar.ratio(F.sum(d).over(whole), F.sum("total").over(whole), 0.5)) if "target" in votes.columns else rows.join(targets, state).withColumn("swing", F.col("target") - scalar.ratio(F.sum(d).over(whole), F.sum("total").over(whole), 0.5))
    return rows.withColumn("estimate", scalar.clip01(F.col("share") + F.col("swing")))


def weighted_share(rows: DataFrame, keys: list[str], share: str = "estimate", weight: str = "total") -> DataFrame:
    """`keys` and the weighted mean share, not rounded, 0.5 without votes; rows of no zone don't count."""
    kept = rows.filter(" and ".join(f"{k} is not null" for k in keys))
    return kept.groupBy(*keys).agg(scalar.ratio(F.sum(F.col(share) * F.col(weight)), F.sum(weight), 0.5).alias("share"))


def two_party_share(rows: DataFrame, keys: list[str]) -> DataFrame:
    kept = rows.filter(" and ".join(f"{k} is not null" for k in keys))
    return kept.groupBy(*keys).agg(F.round(scalar.ratio(F.sum("d"), F.sum("d") + F.sum("r"), 0.5), 4).alias("share"))


def labelled(shares: DataFrame, digits: int = 4) -> DataFrame:
    """Lean, margin and label are the whole share's; only then is it rounded, to be kept."""
    s = F.col("share")
    return shares.withColumns({"lean": scalar.lean(s), "margin": scalar.margin(s), "label": scalar.lean_label(s)}).withColumn("share", F.round("share", digits))


def seat_totals(districts: DataFrame) -> DataFrame:
    """state, d_seats, r_seats, seats; state null is the nation."""
    return districts.rollup("state").agg(F.count_if(F.col("lean") == "D").alias("d_seats"), F.count_if(F.col("lean") == "R").alias("r_seats"), F.count(F.lit(1)).alias("seats"))


def margin_bands(districts: DataFrame, bands: tuple[int, ...] = model.MARGIN_BANDS) -> DataFrame:
    """band, D, R, total and the states of the districts within it."""
    rows = districts.withColumn("band", F.explode(F.filter(F.array(*map(F.lit, bands)), lambda b: F.col("margin") <= b)))
    sums = rows.groupBy("band").agg(F.count_if(F.col("lean") == "D").alias("d_seats"), F.count_if(F.col("lean") == "R").alias("r_seats"), F.count(F.lit(1)).alias("seats"), F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"))
    return sums


def at_large(districts: DataFrame, rows: DataFrame) -> DataFrame:
    return districts.unionByName(labelled(rows), allowMissingColumns=True)


def enacted_districts(rows: DataFrame, code: str = "cd") -> DataFrame:
    """Rows of real districts: placeholder and non-numeric codes go; `zone` counts from 0."""
    number = F.col(code).try_cast("int")
    return rows.filter((F.col(code) != "ZZ") & number.isNotNull()).withColumn("zone", number - 1)


def seat_deviation(proposed: DataFrame, enacted: DataFrame) -> DataFrame:
    """state, proposed and enacted D seats and their difference, over the states in both."""
    both = proposed.select("state", F.col("d_seats").alias("proposed_d")).join(enacted.select("state", F.col("d_seats").alias("enacted_d")), "state")
    return both.withColumn("deviation", F.col("proposed_d") - F.col("enacted_d"))


def counts_or_zero(places: DataFrame, counts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All places with their counts, 0 where there are none."""
    return places.join(counts.select(key, *columns), key, "left").na.fill(0, columns)


def looked_up(rows: DataFrame, known: DataFrame, key: str, value: str, otherwise: float) -> DataFrame:
    """`rows` with a value by key, or another where there is none."""
    return rows.join(known.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(otherwise)))


def competitive_counts(districts: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    return districts.agg(*(F.count_if(F.col("margin") <= t).alias(f"within_{t}") for t in limits))


def diversity(counts: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    kept = counts.filter(" and ".join(f"{k} is not null" for k in keys))
    sums = kept.groupBy(*keys).agg(*(F.sum(F.coalesce(g, F.lit(0))).cast("double").alias(g) for g in groups))
    return sums.select(*keys, F.round(scalar.herfindahl(F.array(*groups)), 6).alias("diversity"))


def summary(rows: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return rows.agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 4).alias("median"), F.round(F.stddev_pop(v), 4).alias("std"), F.count(v).alias("n"))


def histogram(rows: DataFrame, value: str, width: float = 0.05, bins: int = 21) -> DataFrame:
    """bin, n over [0, bins * width], the last bin closed."""
    at = F.least(F.floor(F.round(F.col(value) / width, 9)), F.lit(bins - 1))
    return rows.filter(F.col(value).between(0.0, bins * width)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def regression(rows: DataFrame, y: str, x: str) -> DataFrame:
    return rows.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def kernel_density(rows: DataFrame, value: str, low: float, high: float, points: int = 300, factor: float = 0.12) -> DataFrame:
    """x, density on an even grid, Gaussian kernels of `factor` sample deviations; equal values are summed first, so the grid meets each value once."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    spread = F.broadcast(rows.agg((F.stddev_samp(value) * factor).alias("h"), F.count(value).alias("total")))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * ((high - low) / (points - 1)))
    cells = counts.crossJoin(spread).select("n", "v", "h", "total", F.posexplode(grid).alias("at", "x"))
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), F.lit(2.0)))
    return cells.groupBy("at").agg(F.round(F.sum(F.col("n") * kernel / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))), 6).alias("density"))


def padded_bounds(rows: DataFrame, x: Column, y: Column, share: float = 0.02) -> DataFrame:
    box = rows.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    w, h = (F.col("x1") - F.col("x0")) * share, (F.col("y1") - F.col("y0")) * share
    return box.select(*(F.round(c, 6).alias(n) for n, c in (("x0", F.col("x0") - w), ("y0", F.col("y0") - h), ("x1", F.col("x1") + w), ("y1", F.col("y1") + h))))


def work_list(states: DataFrame, templates: DataFrame, manifest: DataFrame) -> DataFrame:
    """The datasets still to be fetched: every template of every state that needs it, less those that are there."""
    asked = states.crossJoin(templates).filter("k > 1 or not multi_only")
    url = F.format_string("%s/%s/%s_%s.zip", "base", "dataset", F.lower(F.replace("name", F.lit(" "), F.lit("_"))), "fips")
    return asked.select("fips", "dataset", url.alias("url")).join(manifest.filter("status = 'OK'").select("fips", "dataset"), ["fips", "dataset"], "left_anti")


def manifest_status(parts: DataFrame) -> DataFrame:
    """A dataset of many parts is OK, PARTIAL or FAILED."""
    bad = F.count_if(~F.col("ok"))
    return parts.groupBy("fips").agg(F.count(F.lit(1)).alias("parts"), bad.alias("failed")).withColumn("status", F.when(F.col("failed") == 0, "OK").when(F.col("failed") < F.col("parts"), "PARTIAL").otherwise("FAILED"))
