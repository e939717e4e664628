"""The dual graph as two tables, units and edges (u < v), and what is asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweave import model
from planweave.functions import geometry, scalar
from planweave.operators import metrics
from planweave.session import discard, stored


def weighted(edges: DataFrame, units: DataFrame) -> DataFrame:
    """edges with `weight` by the administrative units that the ends share and the barriers between (columns road and, if there, water)."""
    at = lambda end: units.select(F.col("node_id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("county_fips", "place_fips", "cousub_fips")))
    same = lambda c: scalar.same_admin(F.col(f"u_{c}"), F.col(f"v_{c}"))
    both = edges.join(at("u"), "u").join(at("v"), "v")
    weight = scalar.edge_weight(same("county_fips"), same("place_fips"), same("cousub_fips"), F.col("road"), F.col("water") if "water" in edges.columns else None)
    return both.select("u", "v", "border_len_m", weight.alias("weight"))


def transition_kernel(edges: DataFrame, beta: float) -> DataFrame:
    """src, dst, p: the walk's chance of each step, falling with the weight."""
    both = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight").union(edges.select("v", "u", "weight"))
    pull = F.pow("weight", F.lit(-beta))
    return both.select("src", "dst", (pull / F.sum(pull).over(Window.partitionBy("src"))).alias("p"))


def components(units: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, component (its least node_id), by rounds of least labels with pointer jumps; each round is written to the shared folder."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
    both = stored(both, "neighbours")
    now = stored(units.select("node_id", F.col("node_id").alias("component")), "labels")
    while True:
        offers = both.join(now.withColumnsRenamed({"node_id": "a"}), "a").groupBy(F.col("b").alias("node_id")).agg(F.min("component").alias("offer"))
        lower = now.join(offers, "node_id", "left").select("node_id", F.col("component").alias("old"), F.least("component", "offer").alias("component"))
        jump = now.select(F.col("node_id").alias("component"), F.col("component").alias("beyond"))
        after = stored(lower.join(jump, "component").select("node_id", F.least("component", "beyond").alias("component"), "old"), "labels")
        done = after.filter("component <> old").isEmpty()
        discard(now)
        now = after.drop("old")
        now.stored_at = after.stored_at
        if done:
            discard(both)
            return now.select("node_id", "component")


def largest_component(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Units of the component with the most nodes (ties: the least id); ids keep their gaps."""
    found = components(units, edges)
    top = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return units.join(found.join(F.broadcast(top), "component", "left_semi"), "node_id", "left_semi")


def isolated_units(units: DataFrame, edges: DataFrame) -> DataFrame:
    return units.join(edges.select(F.explode(F.array("u", "v")).alias("node_id")), "node_id", "left_anti")


def graph_summary(units: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = units.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("pop").alias("total_pop"), F.count_if(F.col("pop") == 0).alias("zero_pop"))
    return nodes.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"), F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"), F.round(F.avg("weight"), 6).alias("weight_mean")))


def polygon_segments(polygons: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """`key` and its boundary segments, ends rounded and in a canonical order: a border that two polygons share is the same row twice."""
    rows = polygons.select(key, F.explode(F.flatten(F.transform("geom", geometry.segments))).alias("s"))
    point = lambda p: F.struct(F.round(F.col(f"s.{p}.x"), digits).alias("x"), F.round(F.col(f"s.{p}.y"), digits).alias("y"))
    low, high = F.least(point("a"), point("b")), F.greatest(point("a"), point("b"))
    return rows.select(key, low.alias("p"), high.alias("q")).withColumn("len_m", F.hypot(F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")))


def split_segments(segments: DataFrame, key: str, size: float, tolerance: float = 1e-3) -> DataFrame:
    """Segments (`key`, p, q) cut at all corners that lie on them, of whichever polygon: borders whose two sides have other corners become equal rows.

    Segments and corners meet by an equi-join on grid cells of `size`, so no pair of distant ones is looked at.
    Joins of exploded rows are merge joins by hint: Spark takes such rows for as small as the file
    that they were exploded from, and would send them all to the driver for a broadcast.
    A segment goes to its cells, and with its cuts to its key's others, where a join by key finds it.
    """
    corners = segments.select(F.explode(F.array("p", "q")).alias("v")).distinct().select("v", F.floor(F.col("v.x") / size).alias("cx"), F.floor(F.col("v.y") / size).alias("cy"))
    cells = lambda c: F.explode(F.sequence(F.floor((F.least(f"p.{c}", f"q.{c}") - tolerance) / size), F.floor((F.greatest(f"p.{c}", f"q.{c}") + tolerance) / size)))
    tiled = segments.select(key, "p", "q").filter(F.col(key).isNotNull()).withColumn("cx", cells("x")).withColumn("cy", cells("y"))
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    along = ((F.col("v.x") - F.col("p.x")) * dx + (F.col("v.y") - F.col("p.y")) * dy) / (dx * dx + dy * dy)
    off = F.abs((F.col("v.x") - F.col("p.x")) * dy - (F.col("v.y") - F.col("p.y")) * dx) / F.hypot(dx, dy)
    on = (F.col("v") != F.col("p")) & (F.col("v") != F.col("q")) & (off <= tolerance)
    met = tiled.join(corners.hint("merge"), ["cx", "cy"]).withColumn("along", along).filter(on & (F.col("along") > 0) & (F.col("along") < 1))
    # a piece begins at its segment's first end or at a cut, and ends where the next begins; a segment that is there several times has each as often
    starts = segments.select(key, "p", "q", F.lit(0.0).alias("along"), F.col("p").alias("v")).unionByName(met.select(key, "p", "q", "along", "v"))
    ordered = f"over (partition by `{key}`, p, q order by along, v)"
    first = starts.repartition(key).withColumn("first", F.expr(f"if(struct(along, v) <=> lag(struct(along, v)) {ordered}, null, v)"))
    parts = first.select(key, F.struct(F.col("v").alias("a"), F.coalesce(F.expr(f"lead(first) ignore nulls {ordered}"), "q").alias("b")).alias("s"))
    low, high = F.least("s.a", "s.b"), F.greatest("s.a", "s.b")
    return parts.select(key, low.alias("p"), high.alias("q")).withColumn("len_m", F.hypot(F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")))


def adjacency(segments: DataFrame, key: str, ends: list[str], least: float = model.MIN_BORDER_M) -> DataFrame:
    """u, v, border_len_m of the owners of common segments (columns `ends` and len_m), by an equi-join; where corners aren't shared, of `split_segments`."""
    a = segments.select(F.col(key).alias("u"), *ends, "len_m")
    b = segments.select(F.col(key).alias("v"), *ends)
    return a.join(b.hint("merge"), ends).filter("u < v").groupBy("u", "v").agg(F.sum("len_m").alias("border_len_m")).filter(F.col("border_len_m") >= least)


def dissolved_boundary(segments: DataFrame, owners: DataFrame, key: str, group: list[str], ends: list[str]) -> DataFrame:
    """`group`, perimeter_m: of the segments of a group's polygons those that occur an odd number of times are its boundary."""
    once = segments.hint("merge").join(owners, key).groupBy(*group, *ends).agg(F.first("len_m").alias("len_m"), F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    return once.groupBy(*group).agg(F.sum("len_m").alias("perimeter_m"))


def plan_perimeters(segments: DataFrame, plans: DataFrame, key: str, ends: list[str]) -> DataFrame:
    """step, zone, perimeter_m of plans (step, node_id, zone): `dissolved_boundary` of all plans at once.

    A node's districts travel packed, so a segment meets its owners' once a block of steps, and
    is only there a plan at a time where it is some zone's boundary.
    """
    held = metrics.packed(plans).withColumnRenamed("node_id", key)
    met = segments.join(held.hint("merge"), key).groupBy(*ends, "_block").agg(F.first("len_m").alias("len_m"), F.collect_list("_of").alias("lists"))
    # what one of two has and the other has not; of more, what an odd number has
    odd = F.reduce("lists", F.slice(F.get("lists", F.lit(0)), 1, 0), lambda a, b: F.concat(F.array_except(a, b), F.array_except(b, a)))
    # nearly all segments have one owner, or two in the same steps: no list is compared with all of another
    a, b = F.get("lists", F.lit(0)), F.get("lists", F.lit(1))
    steps = lambda c: F.transform(c, lambda x: x["step"])
    unlike = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda x: ~x["a"]["zone"].eqNullSafe(x["b"]["zone"]))
    apart = F.flatten(F.transform(unlike, lambda x: F.array(x["a"], x["b"])))
    odd = F.when(F.size("lists") == 1, a).when((F.size("lists") == 2) & (steps(a) == steps(b)), apart).otherwise(odd)
    return met.select("len_m", F.explode(odd).alias("x")).groupBy("x.step", "x.zone").agg(F.sum("len_m").alias("perimeter_m"))


def subtree_sums(tree: DataFrame) -> DataFrame:
    """node, subtree_pop from (node, parent, pop), one row a node; a node without parent is a root, and there may be many. A parent that has no row is a root without pop of its own.

    The walk around the tree, down each branch and up again, is a list of two steps a
    node; sums from every step to the end come by doubling what is looked ahead, so the
    rounds are the logarithm of the nodes whatever the height, and each is of as many rows.
    """
    down, up = F.col("node") * 2, F.col("node") * 2 + 1
    family = Window.partitionBy("parent").orderBy("node")
    below = tree.filter("parent is not null")
    absent = below.select(F.col("parent").alias("node")).distinct().join(tree, "node", "left_anti")
    first = below.groupBy(F.col("parent").alias("node")).agg((F.min("node") * 2).alias("first"))
    step = below.withColumn("sibling", F.lead("node").over(family)).join(first, "node", "left")
    above = tree.select(F.col("node").alias("parent"), F.col("parent").isNull().alias("of_root"))
    step = step.join(above, "parent", "left")
    of_root = F.coalesce("of_root", F.lit(True))
    after_up = F.coalesce(F.col("sibling") * 2, F.when(~of_root, F.col("parent") * 2 + 1))
    now = step.select(down.alias("at"), F.coalesce("first", up).alias("next"), F.col("pop").alias("total"))
    now = stored(now.union(step.select(up, after_up, F.lit(0).cast(tree.schema["pop"].dataType))), "walk")
    while not now.filter("next is not null").isEmpty():
        ahead = now.select(F.col("at").alias("next"), F.col("next").alias("beyond"), F.col("total").alias("more"))
        further = now.join(ahead, "next", "left").select("at", F.col("beyond").alias("next"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
        after = stored(further.select("at", "next", F.col("total").cast(now.schema["total"].dataType).alias("total")), "walk")
        discard(now)
        now = after
    ends = now.select(F.shiftright("at", 1).alias("node"), F.when(F.col("at") % 2 == 0, F.col("total")).otherwise(-F.col("total")).alias("total"))
    inner = ends.groupBy("node").agg(F.sum("total").alias("subtree_pop"))
    # of a root, its own and its children's
    roots = tree.filter("parent is null").select("node", "pop").unionByName(absent.withColumn("pop", F.lit(0).cast(tree.schema["pop"].dataType)))
    tops = below.select("node", "parent").join(inner, "node").groupBy(F.col("parent").alias("node")).agg(F.sum("subtree_pop").alias("held"))
    outer = roots.join(tops, "node", "left").select("node", (F.col("pop") + F.coalesce("held", F.lit(0))).alias("subtree_pop"))
    return inner.unionByName(outer)
