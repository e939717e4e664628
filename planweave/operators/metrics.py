"""Scores of plans: every plan of an ensemble at once, as grouped aggregates over (step, zone)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions import scalar


#: Steps whose districts of a node travel in one row.
STEPS = 1024


def packed(plans: DataFrame) -> DataFrame:
    """node_id, _block, _of: a node's districts (step, zone), STEPS steps a row; plans that are packed already as they are."""
    if "_of" in plans.columns:
        return plans
    return plans.groupBy("node_id", F.expr(f"step div {STEPS}").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("step", "zone"))).alias("_of"))


def unpacked(plans: DataFrame) -> DataFrame:
    """Plans, packed or not, as rows step, node_id, zone."""
    return plans.select("node_id", F.inline("_of")).select("step", "node_id", "zone") if "_of" in plans.columns else plans


def steps_of(plans: DataFrame) -> DataFrame:
    """The distinct steps of plans, packed or not; of packed ones, nodes with the same list of steps count once."""
    rows = plans.select(F.col("_of.step").alias("steps")).distinct().select(F.explode("steps").alias("step")) if "_of" in plans.columns else plans.select("step")
    return rows.distinct()


def with_units(plans: DataFrame, units: DataFrame) -> DataFrame:
    """step, node_id, zone of plans, packed or not, with the columns of `units`. Packed ones meet the units before they are rows."""
    if "_of" not in plans.columns:
        return plans.join(units, "node_id")
    held = plans.select("node_id", F.col("_of.step").alias("_steps"), F.col("_of.zone").alias("_zones"))
    rows = held.hint("merge").join(units, "node_id").select(*units.columns, "_zones", F.posexplode("_steps").alias("_at", "step"))
    return rows.select(*units.columns, "step", F.get("_zones", F.col("_at")).alias("zone"))


def cut_marks(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """step, u, v, border_len_m, du, dv: every edge of every plan with the districts of its ends.

    A node's districts are gathered once, STEPS steps a row, and it is those rows that
    edges are joined with: edges times plans are only there after the last shuffle. The joins
    are merge joins by hint, as Spark takes packed rows for small ones and would broadcast them.
    Steps and districts go as arrays beside each other, and where both ends have the same
    steps no struct is made of an edge and a step.
    """
    held = packed(plans)
    at = lambda end: held.hint("merge").select(F.col("node_id").alias(end), "_block", F.col("_of.step").alias(f"_steps_{end}"), F.col("_of.zone").alias(f"_{end}"))
    both = edges.select("u", "v", "border_len_m").join(at("u"), "u").join(at("v"), ["v", "_block"])
    # plans that leave out nodes: of both ends' steps in one order, those that come twice
    tagged = lambda end, side: F.zip_with(f"_steps_{end}", f"_{end}", lambda step, zone: F.struct(step.alias("step"), F.lit(side).alias("side"), zone.alias("zone")))
    twice = lambda all_: F.filter(F.zip_with(all_, F.slice(all_, 2, F.size(all_)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: F.coalesce(x["a"]["step"] == x["b"]["step"], F.lit(False)))
    met = F.transform(F.array(F.array_sort(F.concat(tagged("u", 0), tagged("v", 1)))), twice)[0]
    parts = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("steps", "du", "dv"), strict=True)))
    apart = F.transform(F.array(met), lambda x: parts(x["a"]["step"], x["a"]["zone"], x["b"]["zone"]))[0]
    pairs = F.when(F.col("_steps_u") == F.col("_steps_v"), parts(F.col("_steps_u"), F.col("_u"), F.col("_v"))).otherwise(apart)
    rows = both.select("u", "v", "border_len_m", pairs.alias("_x")).select("u", "v", "border_len_m", "_x", F.posexplode("_x.steps").alias("_at", "step"))
    return rows.select("step", "u", "v", "border_len_m", *(F.get(f"_x.{c}", F.col("_at")).alias(c) for c in ("du", "dv")))


def zone_sums(units: DataFrame, edges: DataFrame, plans: DataFrame, k: int) -> DataFrame:
    """step, zone, pop, area_m2, perimeter_m, and what of the step's cut borders begins there: cuts, cut_m, least_m; `counted` for districts 0..k-1, empty ones too.

    The perimeter is that of the units less twice the borders inside, so nothing is
    dissolved, and one pass over the edges gives inner and cut borders.
    """
    sums = with_units(plans, units.select("node_id", "pop", "area_m2", "perimeter_m")).groupBy("step", "zone").agg(F.sum("pop").alias("pop"), F.sum("area_m2").alias("area_m2"), F.sum("perimeter_m").alias("outer"))
    cut, border = F.col("du") != F.col("dv"), F.col("border_len_m")
    borders = cut_marks(edges, plans).groupBy("step", F.col("du").alias("zone")).agg(
        F.sum(F.when(~cut, border * 2)).alias("inner"), F.count_if(cut).alias("cuts"), F.sum(F.when(cut, border)).alias("cut_m"), F.min(F.when(cut, border)).alias("least_m"),
    )
    domain = steps_of(plans).select("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias("zone"), F.lit(True).alias("counted"))
    out = domain.join(sums, ["step", "zone"], "left").join(borders, ["step", "zone"], "full")
    out = out.na.fill(0, ["pop", "area_m2", "outer", "inner", "cuts", "cut_m"])
    return out.select("step", "zone", "pop", "area_m2", (F.col("outer") - F.col("inner")).alias("perimeter_m"), "cuts", "cut_m", "least_m", "counted")


def zone_table(units: DataFrame, edges: DataFrame, plans: DataFrame, k: int) -> DataFrame:
    """step, zone, pop, area_m2, perimeter_m for districts 0..k-1, empty ones too."""
    return zone_sums(units, edges, plans, k).filter("counted").select("step", "zone", "pop", "area_m2", "perimeter_m")


def plan_metrics(units: DataFrame, edges: DataFrame, plans: DataFrame, k: int, digits: int = 6, least: bool = False) -> DataFrame:
    """One row a step: compactness, population deviation, cut edges and their border; with `least`, the shortest cut border too."""
    ideal = F.broadcast(units.agg((F.sum("pop") / F.lit(float(k))).alias("ideal")))
    scored = zone_sums(units, edges, plans, k).crossJoin(ideal)
    counted = lambda c: F.when(F.col("counted"), c)
    pp, dev = counted(scalar.polsby_popper(F.col("area_m2"), F.col("perimeter_m"))), counted(F.abs(F.col("pop") - F.col("ideal")) / F.col("ideal"))
    named = {"pp_min": F.min(pp), "pp_mean": F.avg(pp), "pp_max": F.max(pp), "pop_dev_max": F.max(dev), "pop_dev_mean": F.avg(dev)}
    return scored.groupBy("step").agg(
        *(F.round(c, digits).alias(n) for n, c in named.items()),
        F.sum("cuts").alias("cut_edges"),
        F.sum("cut_m").alias("cut_border_m"),
        *([F.coalesce(F.min("least_m"), F.lit(0.0)).alias("min_cut_border_m")] if least else []),
    )


def cut_borders(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """step, cut_edges, cut_border_m, min_cut_border_m; zeros where nothing is cut."""
    cut = F.col("du") != F.col("dv")
    return cut_marks(edges, plans).groupBy("step").agg(
        F.count_if(cut).alias("cut_edges"),
        F.coalesce(F.sum(F.when(cut, F.col("border_len_m"))), F.lit(0.0)).alias("cut_border_m"),
        F.coalesce(F.min(F.when(cut, F.col("border_len_m"))), F.lit(0.0)).alias("min_cut_border_m"),
    )


def peninsula_ratio(borders: DataFrame) -> DataFrame:
    mean = F.greatest(F.col("cut_border_m") / F.greatest(F.col("cut_edges"), F.lit(1)), F.lit(1.0))
    return borders.withColumn("peninsula_ratio", F.col("min_cut_border_m") / mean)


def county_splits(units: DataFrame, plans: DataFrame) -> DataFrame:
    """step, county_splits (districts a county has more than one of), max_county_districts; units of no county don't count."""
    held = units.filter(F.col("county").isNotNull()).select("node_id", "county")
    pairs = with_units(plans, held).groupBy("step", "county").agg(F.countDistinct("zone").alias("n"))
    return pairs.groupBy("step").agg(F.sum(F.col("n") - 1).alias("county_splits"), F.max("n").alias("max_county_districts"))


def county_splits_pairs(units: DataFrame, plans: DataFrame) -> DataFrame:
    """The variant by distinct pairs: units of no county count as a county in the first term only."""
    pairs = plans.join(units.select("node_id", "county"), "node_id").select("step", "county", "zone").distinct()
    return pairs.groupBy("step").agg((F.count(F.lit(1)) - F.countDistinct("county")).alias("county_splits"))


def zone_population(units: DataFrame, plans: DataFrame) -> DataFrame:
    return plans.join(units.select("node_id", "pop"), "node_id").groupBy("step", "zone").agg(F.sum("pop").alias("population"), F.count(F.lit(1)).alias("n_units"))


def population_deviation(units: DataFrame, plans: DataFrame, k: int) -> DataFrame:
    """step, its largest deviation and the (lowest) zone that has it."""
    ideal = F.broadcast(units.agg((F.sum("pop") / F.lit(float(k))).alias("ideal")))
    dev = zone_population(units, plans).crossJoin(ideal).select("step", "zone", (F.abs(F.col("population") - F.col("ideal")) / F.col("ideal")).alias("dev"))
    worst = F.row_number().over(Window.partitionBy("step").orderBy(F.desc("dev"), "zone"))
    return dev.withColumn("n", worst).filter("n = 1").select("step", F.round("dev", 6).alias("pop_dev_max"), F.col("zone").alias("worst_zone"))


def districts_of_subset(units: DataFrame, plans: DataFrame, county: int) -> DataFrame:
    """step, how many districts the units of a county are in."""
    return plans.join(units.filter(F.col("county") == county).select("node_id"), "node_id", "left_semi").groupBy("step").agg(F.countDistinct("zone").alias("districts"))


def ordered_chunks(rows: DataFrame, key: str, width: int) -> DataFrame:
    return rows.withColumn("_chunk", F.floor(F.col(key) / width))


def running(metrics: DataFrame, valid, key: str = "event_id", width: int = 4096) -> DataFrame:
    """Running best and share of valid rows in `key` order: inside chunks of keys, then from the chunks before.

    The prefix over the whole order would be one task; this way only the chunks' totals are.
    """
    rows = ordered_chunks(metrics.withColumn("valid", valid.cast("int")), key, width)
    inner = Window.partitionBy("_chunk").orderBy(key)
    sums = {"max_score": F.max("score"), "min_cost": F.min("cost"), "max_valid_score": F.max(F.when(F.col("valid") == 1, F.col("score"))), "n_valid": F.sum("valid"), "n": F.count(F.lit(1))}
    totals = rows.groupBy("_chunk").agg(*(c.alias(n) for n, c in sums.items()))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = {"max_score": F.max, "min_cost": F.min, "max_valid_score": F.max, "n_valid": F.sum, "n": F.sum}
    totals = totals.select("_chunk", *(f(n).over(before).alias(f"_{n}") for n, f in carry.items()))
    out = rows.select("*", *(c.over(inner).alias(n) for n, c in sums.items())).join(totals, "_chunk")
    share = (F.col("n_valid") + F.coalesce("_n_valid", F.lit(0))) / (F.col("n") + F.coalesce("_n", F.lit(0))).cast("double")
    return out.select(
        key,
        F.greatest("max_score", "_max_score").alias("running_max"),
        F.least("min_cost", "_min_cost").alias("running_min"),
        F.when(F.col("valid") == 1, F.greatest("max_valid_score", "_max_valid_score")).alias("running_valid_max"),
        F.round(share, 6).alias("valid_fraction"),
    )
