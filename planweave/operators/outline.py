"""Polygons put together to one, and outlines simplified without tearing neighbours apart.

Sides are directed, inside on the left. Of the polygons of a group, sides that are there both
ways cancel; what is left is the group's boundary, whose sides are linked, each to the one
that bounds the same piece of the inside at its end, and ranked along their rings by pointer
doubling, so a ring may be as long as a continent's coast: no ring, group or border passes one
task before it is a value of a row, as polygons are.

Borders must have the same corners on both sides, which `graph.split_segments` sees to.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions import geometry
from planweave.operators import metrics, spatial
from planweave.session import discard, stored

#: Sides of a group's boundary that one task walks around, and sides that a task is given about.
LOCAL, DEALT = 1_000_000, 50_000


def directed_sides(polygons: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """`keys`, p, q of all sides of the polygons (geom), corners rounded, inside on the left."""
    rows = polygons.select(*keys, F.explode(F.flatten(F.transform(geometry.oriented(F.col("geom")), geometry.segments))).alias("_s"))
    corner = lambda c: F.struct(F.round(F.col(f"_s.{c}.x"), digits).alias("x"), F.round(F.col(f"_s.{c}.y"), digits).alias("y"))
    return rows.select(*keys, corner("a").alias("p"), corner("b").alias("q")).filter("p <> q")


def boundary(sides: DataFrame, group: list[str]) -> DataFrame:
    """`group`, p, q: the sides (p, q) of a group that occur an odd number of times, whichever way, in the direction that most have."""
    forth = F.col("p") < F.col("q")
    net = sides.groupBy(*group, F.least("p", "q").alias("_low"), F.greatest("p", "q").alias("_high")).agg(F.sum(F.when(forth, 1).otherwise(-1)).alias("_net"))
    kept = net.filter("_net % 2 <> 0")
    return kept.select(*group, F.when(F.col("_net") > 0, F.col("_low")).otherwise(F.col("_high")).alias("p"), F.when(F.col("_net") > 0, F.col("_high")).otherwise(F.col("_low")).alias("q"))


def ranked(links: DataFrame) -> DataFrame:
    """id, chain, ahead: of links (id, next; null at an end), the chain or ring that an id is in, and how many links it is before the chain's own.

    The chain's own is the end, or of a ring the least id. Each round looks twice as far
    ahead as the one before, so there are as many as the logarithm of the longest chain.
    """
    own = F.struct(F.col("next").isNotNull().alias("ring"), F.col("id").alias("id"))
    now, reach = stored(links.select("id", "next", own.alias("own"), F.lit(0).cast("long").alias("ahead")), "links"), 1
    while True:
        beyond = now.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("own").alias("other"), F.col("ahead").alias("more"))
        less = F.coalesce(F.col("other") < F.col("own"), F.lit(False))
        met = now.join(beyond, "next", "left").select(
            "id", F.col("after").alias("next"), F.when(less, F.col("other")).otherwise(F.col("own")).alias("own"), F.when(less, F.col("more") + reach).otherwise(F.col("ahead")).alias("ahead"),
            (F.col("other") != F.col("own")).alias("changed"),
        )
        after = stored(met, "links")
        discard(now)
        if after.filter("changed").isEmpty():
            return after.select("id", F.col("own.id").alias("chain"), "ahead")
        now, reach = after.drop("changed"), reach * 2
        now.stored_at = after.stored_at


def stitched(sides: DataFrame, group: list[str]) -> DataFrame:
    """`group`, ring, points: the rings of a group's boundary (p, q), none of which meets itself. Outer rings run counter-clockwise, holes clockwise.

    A group of at most LOCAL sides is walked around in one task; the sides of a larger one are
    linked by joins and ranked.
    """
    held = stored(sides.select(*group, "p", "q"), "sides")
    tasks = -(-held.count() // DEALT)  # sides are few bytes, so Spark would give all to a few tasks
    large = stored(held.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LOCAL).select(*(F.col(c).alias(f"_{c}") for c in group)), "large")
    among = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group))
    if large.isEmpty():
        return _walked(held, group, tasks)
    return _walked(held.join(large, among, "left_anti"), group, tasks).unionByName(_linked(held.join(large, among, "left_semi"), group))


def _walked(sides: DataFrame, group: list[str], tasks: int) -> DataFrame:
    kinds = ", ".join(f"`{c}` {sides.schema[c].dataType.simpleString()}" for c in group)

    def run(table: pa.Table) -> pa.Table:
        p, q = (np.column_stack([table[f"_{c}{e}"].to_numpy() for c in "xy"]) for e in "pq")
        rings = []
        for ring in walks(p, q):
            corners = p[ring]
            if len(np.unique(corners.view(np.complex128))) == len(ring):
                rings.append(ring)
            else:
                rings += [[ring[i] for i in loop] for loop in loops_of(list(map(tuple, corners.tolist())))]
        order, offsets = np.fromiter((i for ring in rings for i in ring), np.int64), np.cumsum([0, *map(len, rings)]).astype(np.int32)
        keys = {c: pa.chunked_array([table[c].combine_chunks().take(pa.array(np.zeros(len(rings), np.int64)))]) for c in group}
        points = pa.StructArray.from_arrays([pa.array(p[order, 0]), pa.array(p[order, 1])], ["x", "y"])
        return pa.table(keys | {"ring": pa.array(range(len(rings)), pa.int64()), "points": pa.ListArray.from_arrays(pa.array(offsets), points)})

    flat = sides.select(*group, *(F.col(f"{e}.{c}").alias(f"_{c}{e}") for e in "pq" for c in "xy"))  # structs take more bytes than what is in them
    return flat.repartition(max(1, tasks), *group).groupBy(*group).applyInArrow(run, f"{kinds}, ring long, points {geometry.RING}")


def walks(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """The sides (by place; rows of x, y) of a boundary in the order of its rings."""
    n = len(starts)
    corner = np.unique(np.ascontiguousarray(np.concatenate([starts, ends]) + 0.0).view(np.complex128).ravel(), return_inverse=True)[1]
    order = np.argsort(corner[:n], kind="stable")
    first, last = (np.searchsorted(corner[:n][order], corner[n:], side) for side in ("left", "right"))
    after = np.where(first < last, order[np.minimum(first, n - 1)], np.arange(n)).tolist()  # polygons that overlap may leave an end, which closes the ring

    def turn(a: np.ndarray, b: np.ndarray) -> float:
        return math.atan2(b[1] - a[1], b[0] - a[0])

    for i in np.flatnonzero(last - first > 1).tolist():
        back = turn(ends[i], starts[i])
        after[i] = min(order[first[i] : last[i]].tolist(), key=lambda j: (back - turn(starts[j], ends[j])) % (2 * math.pi) or 2 * math.pi)
    out, seen = [], [False] * n
    for i in range(n):
        ring = []
        while not seen[i]:
            seen[i] = True
            ring.append(i)
            i = after[i]
        if ring:
            out.append(ring)
    return out


def _linked(sides: DataFrame, group: list[str]) -> DataFrame:
    rows = stored(sides.withColumn("_side", F.monotonically_increasing_id()), "sides")
    turn = lambda a, b: F.atan2(b["y"] - a["y"], b["x"] - a["x"])
    p, q = F.col("p"), F.col("q")
    ends = rows.select(*group, q.alias("_v"), F.struct(F.col("_side").alias("id"), turn(q, p).alias("turn")).alias("comes"), F.lit(None).cast("struct<id:bigint,turn:double>").alias("goes"))
    ends = ends.unionByName(rows.select(*group, p.alias("_v"), F.lit(None).cast("struct<id:bigint,turn:double>").alias("comes"), F.struct(F.col("_side").alias("id"), turn(p, q).alias("turn")).alias("goes")))
    corners = ends.groupBy(*group, "_v").agg(F.collect_list("comes").alias("comes"), F.collect_list("goes").alias("goes"))
    # the first way out, clockwise from the way back, bounds the same piece of the inside
    clockwise = lambda c, g: F.when(c["turn"] > g["turn"], c["turn"] - g["turn"]).otherwise(c["turn"] - g["turn"] + 2 * np.pi)
    pairs = F.transform("comes", lambda c: F.struct(c["id"].alias("id"), F.array_min(F.transform("goes", lambda g: F.struct(clockwise(c, g).alias("by"), g["id"].alias("id"))))["id"].alias("next")))
    links = corners.select(F.explode(pairs).alias("x")).select("x.id", "x.next")
    placed = rows.join(ranked(links).withColumnsRenamed({"id": "_side", "chain": "_chain", "ahead": "_ahead"}), "_side")
    rings = placed.groupBy(*group, F.col("_chain").alias("ring")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_ahead")).alias("at"), "p"))), lambda s: s["p"]).alias("points"))
    rings = stored(rings, "rings")
    meets = F.size(F.array_distinct("points")) < F.size("points")
    schema = rings.schema
    return rings.filter(~meets).unionByName(rings.filter(meets).mapInArrow(_loops, schema))


def loops_of(corners: list[tuple[float, float]]) -> list[list[int]]:
    """The places of a ring that comes back to some of its corners, as rings that don't."""
    out, way, place = [], [], {}
    for i, key in enumerate(corners):
        if key in place:
            start = place[key]
            loop, way = way[start:], way[:start]
            for other in loop:
                del place[corners[other]]
            out.append(loop)
        place[key] = len(way)
        way.append(i)
    return [*out, way]


def simple_loops(points: list[dict[str, float]]) -> list[list[dict[str, float]]]:
    """`loops_of` of points."""
    return [[points[i] for i in loop] for loop in loops_of([(p["x"], p["y"]) for p in points])]


def _loops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        loops = [simple_loops(points) for points in batch.column("points").to_pylist()]
        places = pa.array([i for i, found in enumerate(loops) for _ in found], pa.int64())
        columns = [pa.array([loop for found in loops for loop in found], c.type) if n == "points" else c.take(places) for n, c in zip(batch.schema.names, batch.columns, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def parts(rings: DataFrame, group: list[str]) -> DataFrame:
    """`group`, part, geom: every outer ring with the holes that lie in it and in no smaller one; geom has the outer ring first."""
    first = F.get("points", F.lit(0))
    near = F.transform("points", lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))  # areas far from the origin would be rounded
    signed = stored(rings.select(*group, "points", geometry.ring_area(near).alias("_area")).withColumn("_id", F.monotonically_increasing_id()), "rings")
    outer = signed.filter("_area > 0").select(*group, F.col("_id").alias("part"), "points", "_area")
    holes = signed.filter("_area < 0").select(*group, F.col("_id").alias("_hole"), F.col("points").alias("_ring"), geometry.inner_point(F.col("points")).alias("_at"))
    # a ring no larger than its group's least hole has none in it; most groups have no holes at all
    # stored, as their size is only known then: rings aren't sent about for a few holes or none
    least = stored(signed.filter("_area < 0").groupBy(*(F.col(c).alias(f"_{c}") for c in group)).agg(F.min(-F.col("_area")).alias("_least")), "least")
    among = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group))
    around = outer.join(least, among & (F.col("_area") > F.col("_least"))).select(*group, "part", F.array("points").alias("geom"))
    found = spatial.points_in_polygons(holes.select(*group, "_hole", F.col("_at.x").alias("x"), F.col("_at.y").alias("y")), around, "part", on=tuple(group))
    first = Window.partitionBy("_hole").orderBy("_area", "part")
    owner = found.select("_hole", "part").join(outer.select("part", "_area"), "part").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_hole", "part")
    held = stored(holes.join(owner, "_hole").groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("_hole", "_ring"))), lambda h: h["_ring"]).alias("_holes")), "holes")
    return outer.join(held, "part", "left").select(*group, "part", F.concat(F.array("points"), F.coalesce("_holes", F.array().cast(geometry.POLYGON))).alias("geom"))


def dissolved(polygons: DataFrame, owners: DataFrame, key: str, group: list[str], digits: int = 3) -> DataFrame:
    """`group`, part, geom: the polygons (key, geom) of each group of `owners` (key, group) as one, a row a part."""
    return dissolved_sides(directed_sides(polygons, [key], digits), owners, key, group)


def dissolved_sides(sides: DataFrame, owners: DataFrame, key: str, group: list[str]) -> DataFrame:
    return parts(stitched(boundary(sides.join(owners, key), group), group), group)


def dissolved_plans(polygons: DataFrame, plans: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """step, zone, part, geom: every zone of every plan (step, node_id, zone), of polygons (key, geom) that don't overlap.

    As `dissolved`, but a node's districts travel packed: a side is only there a plan at a
    time where it is some zone's boundary.
    """
    held = metrics.packed(plans).withColumnRenamed("node_id", key).filter("_of is not null").select(key, "_block", F.col("_of.step").alias("_steps"), F.col("_of.zone").alias("_zones"))
    rows = directed_sides(polygons.join(held.hint("merge"), key), [key, "_block", "_steps", "_zones"], digits)  # a polygon is less than its sides
    # steps and districts go as arrays beside each other, the direction once a side: structs of a step take several times the bytes
    owner = F.struct((F.col("p") < F.col("q")).alias("forth"), F.col("_steps").alias("steps"), F.col("_zones").alias("zones"))
    met = rows.groupBy(F.least("p", "q").alias("_low"), F.greatest("p", "q").alias("_high"), "_block").agg(F.collect_list(owner).alias("owners"))
    mark = lambda step, zone, forth: F.struct(step.alias("step"), zone.alias("zone"), forth.alias("forth"))
    lists = F.transform("owners", lambda o: F.zip_with(o["steps"], o["zones"], lambda step, zone: mark(step, zone, o["forth"])))
    turned = lambda a: F.transform(a, lambda x: mark(x["step"], x["zone"], ~x["forth"]))
    left = F.reduce(lists, F.slice(F.get(lists, F.lit(0)), 1, 0), lambda a, b: F.concat(F.array_except(a, turned(b)), F.array_except(b, turned(a))))
    # nearly all sides have one owner, or two in the same steps: no list is compared with all of another
    a, b = F.get("owners", F.lit(0)), F.get("owners", F.lit(1))
    zones = F.zip_with(a["zones"], b["zones"], lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    unlike = F.filter(F.zip_with(a["steps"], zones, lambda step, z: F.struct(step.alias("step"), z["a"].alias("a"), z["b"].alias("b"))), lambda x: ~x["a"].eqNullSafe(x["b"]))
    apart = F.flatten(F.transform(unlike, lambda x: F.array(mark(x["step"], x["a"], a["forth"]), mark(x["step"], x["b"], b["forth"]))))
    facing = (F.size("owners") == 2) & (a["steps"] == b["steps"]) & (a["forth"] != b["forth"])
    left = F.when(F.size("owners") == 1, F.get(lists, F.lit(0))).when(facing, apart).otherwise(left)
    sides = met.select("_low", "_high", F.explode(left).alias("x")).select("x.step", "x.zone", F.when(F.col("x.forth"), F.col("_low")).otherwise(F.col("_high")).alias("p"), F.when(F.col("x.forth"), F.col("_high")).otherwise(F.col("_low")).alias("q"))
    return parts(stitched(sides, ["step", "zone"]), ["step", "zone"])


def whole(found: DataFrame, group: list[str]) -> DataFrame:
    """`group`, geom: all parts of a group as one polygon."""
    return found.groupBy(*group).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "geom"))), lambda p: p["geom"])).alias("geom"))


def measures(found: DataFrame, group: list[str]) -> DataFrame:
    """`group`, parts, holes, n_points, area_m2, perimeter_m of parts, as `dissolved` gives them."""
    g = F.col("geom")
    rings = F.aggregate(g, F.lit(0.0), lambda t, r: t + geometry.ring_area(r))  # holes run the other way
    each = found.select(*group, (F.size(g) - 1).alias("_h"), F.size(F.flatten(g)).alias("_n"), rings.alias("_a"), geometry.perimeter(g).alias("_m"))
    return each.groupBy(*group).agg(F.count(F.lit(1)).alias("parts"), F.sum("_h").alias("holes"), F.sum("_n").alias("n_points"), F.sum("_a").alias("area_m2"), F.sum("_m").alias("perimeter_m"))


# ---- overlay


def _strips(polygons: DataFrame, key: str, width: float, end: str) -> DataFrame:
    """`key`, strip, and the pieces of its sides in each upright strip: x0 < x1, the heights there, and 1 where the polygon is below, -1 where it is above."""
    rows = polygons.select(key, F.explode(F.flatten(F.transform(geometry.oriented(F.col("geom")), geometry.segments))).alias("_s")).filter("_s.a.x <> _s.b.x")
    back = F.col("_s.b.x") < F.col("_s.a.x")
    at = lambda c, first: F.when(back == F.lit(first), F.col(f"_s.b.{c}")).otherwise(F.col(f"_s.a.{c}"))
    rows = rows.select(key, at("x", True).alias("_lx"), at("y", True).alias("_ly"), at("x", False).alias("_rx"), at("y", False).alias("_ry"), F.when(back, 1).otherwise(-1).alias(f"{end}_way"))
    rows = rows.withColumn("strip", F.explode(F.sequence(F.floor(F.col("_lx") / width), F.floor(F.col("_rx") / width))))
    low, high = F.greatest(F.col("_lx"), F.col("strip") * width), F.least(F.col("_rx"), (F.col("strip") + 1) * width)
    height = lambda x: F.col("_ly") + (x - F.col("_lx")) * (F.col("_ry") - F.col("_ly")) / (F.col("_rx") - F.col("_lx"))
    rows = rows.withColumn(f"{end}_x0", low).withColumn(f"{end}_x1", high).filter(F.col(f"{end}_x0") < F.col(f"{end}_x1"))
    return rows.select(key, "strip", f"{end}_way", f"{end}_x0", f"{end}_x1", height(F.col(f"{end}_x0")).alias(f"{end}_y0"), height(F.col(f"{end}_x1")).alias(f"{end}_y1"))


def overlay_areas(a: DataFrame, b: DataFrame, a_key: str, b_key: str, width: float) -> DataFrame:
    """`a_key`, `b_key`, area_m2: how much of each polygon of `a` is in each of `b`; pairs that share nothing have no row.

    A polygon is what lies below its upper sides less what lies below its lower ones, so what
    two have in common is the sum, over their pairs of sides, of what lies below both: a
    trapezoid, or two where they cross. Sides are cut at strips of `width`, and pairs of
    polygons whose boxes meet are joined by strip, so a side only meets what is above or below it.
    """
    tiled = lambda df, key: df.filter("geom is not null and size(flatten(geom)) > 2").select(key, geometry.bounds(F.col("geom")).alias("_b")).select(key, "_b", F.explode(F.sequence(F.floor(F.col("_b.x0") / width), F.floor(F.col("_b.x1") / width))).alias("_cx")).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_b.y0") / width), F.floor(F.col("_b.y1") / width))))
    ours, theirs = tiled(a, a_key).withColumnRenamed("_b", "_a"), tiled(b, b_key)
    near = (F.col("_a.x0") < F.col("_b.x1")) & (F.col("_a.x1") > F.col("_b.x0")) & (F.col("_a.y0") < F.col("_b.y1")) & (F.col("_a.y1") > F.col("_b.y0"))
    pairs = ours.join(theirs, ["_cx", "_cy"]).filter(near).select(a_key, b_key, F.least("_a.y0", "_b.y0").alias("_base")).distinct()
    met = pairs.join(_strips(a, a_key, width, "a"), a_key).join(_strips(b, b_key, width, "b"), [b_key, "strip"])
    low, high = F.greatest("a_x0", "b_x0"), F.least("a_x1", "b_x1")
    met = met.withColumn("_low", low).withColumn("_high", high).filter("_low < _high")
    height = lambda e, x: F.col(f"{e}_y0") + (x - F.col(f"{e}_x0")) * (F.col(f"{e}_y1") - F.col(f"{e}_y0")) / (F.col(f"{e}_x1") - F.col(f"{e}_x0")) - F.col("_base")
    met = met.select(a_key, b_key, (F.col("a_way") * F.col("b_way")).alias("_way"), (F.col("_high") - F.col("_low")).alias("_wide"), *(height(e, F.col(x)).alias(f"_{e}{x}") for e in "ab" for x in ("_low", "_high")))
    first, last = F.col("_a_low") - F.col("_b_low"), F.col("_a_high") - F.col("_b_high")
    left, right = F.least("_a_low", "_b_low"), F.least("_a_high", "_b_high")
    part = first / F.nullif(first - last, F.lit(0.0))
    middle = F.col("_a_low") + part * (F.col("_a_high") - F.col("_a_low"))
    below = F.when(first * last < 0, (left + middle) * part + (middle + right) * (1 - part)).otherwise(left + right) / 2 * F.col("_wide")
    sums = met.groupBy(a_key, b_key).agg(F.sum(F.col("_way") * below).alias("area_m2"))
    return sums.filter(F.col("area_m2") > 1e-6)


# ---- simplification by arcs


def arcs(sides: DataFrame, key: str) -> DataFrame:
    """arc, a, b, points, twin: the borders between polygons, cut where three or more meet. `a` is on the left; `b` is null outside all.

    The sides (key, p, q) are of polygons that don't overlap. Closed borders without such a
    corner repeat their first point. A twin is one whose ends a shorter border has too.
    """
    forth = F.col("p") < F.col("q")
    both = sides.groupBy(F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")).agg(F.min(F.when(forth, F.col(key))).alias("left"), F.min(F.when(~forth, F.col(key))).alias("right")).filter("not left <=> right")
    turned = F.col("left").isNull() | F.coalesce(F.col("right") < F.col("left"), F.lit(False))
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    rows = stored(both.select(pick("left", "right").alias("a"), pick("right", "left").alias("b"), pick("low", "high").alias("p"), pick("high", "low").alias("q")).withColumn("id", F.monotonically_increasing_id()), "borders")
    end = F.struct("id", "a", "b")
    none = F.lit(None).cast(f"struct<id:bigint,a:{rows.schema['a'].dataType.simpleString()},b:{rows.schema['b'].dataType.simpleString()}>")
    ends = rows.select(F.col("q").alias("v"), end.alias("comes"), none.alias("goes")).unionByName(rows.select(F.col("p").alias("v"), none.alias("comes"), end.alias("goes")))
    corners = ends.groupBy("v").agg(F.collect_list("comes").alias("c"), F.collect_list("goes").alias("g"))
    through = corners.filter((F.size("c") == 1) & (F.size("g") == 1) & (F.col("c")[0]["a"] == F.col("g")[0]["a"]) & F.col("c")[0]["b"].eqNullSafe(F.col("g")[0]["b"]))
    links = rows.select("id").join(through.select(F.col("c")[0]["id"].alias("id"), F.col("g")[0]["id"].alias("next")), "id", "left")
    placed = rows.join(ranked(links), "id")
    step = F.struct((-F.col("ahead")).alias("at"), "p", "q")
    found = placed.groupBy(F.col("chain").alias("arc"), "a", "b").agg(F.array_sort(F.collect_list(step)).alias("s"))
    points = F.concat(F.transform("s", lambda s: s["p"]), F.array(F.element_at("s", -1)["q"]))
    length = F.aggregate("s", F.lit(0.0), lambda t, s: t + F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]))
    found = found.select("arc", "a", "b", points.alias("points"), length.alias("length"))
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    same_ends = Window.partitionBy(F.least(first, last), F.greatest(first, last)).orderBy("length", "arc")
    return found.withColumn("twin", F.row_number().over(same_ends) > 1).drop("length")


def thinned(points: np.ndarray, tolerance: float, twin: bool) -> np.ndarray:
    """The points of a border that stay: its ends, and what is farther than `tolerance` from the line between kept neighbours.

    A closed border keeps three corners at least, a twin one besides its ends, so neither vanishes.
    """
    n = len(points)
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    todo = [(0, n - 1)]
    if n > 2 and (points[0] == points[-1]).all():
        far = int(np.hypot(*(points - points[0]).T).argmax())
        keep[far] = True
        todo = [(0, far), (far, n - 1)]
    least = (2 if (points[0] == points[-1]).all() else 1) if twin or (points[0] == points[-1]).all() else 0
    gaps = []
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        along, off = points[b] - points[a], points[a + 1 : b] - points[a]
        part = np.clip(off @ along / max(along @ along, 1e-300), 0, 1)
        gap = np.hypot(*(off - part[:, None] * along).T)
        worst = int(gap.argmax())
        if gap[worst] > tolerance:
            keep[a + 1 + worst] = True
            todo += [(a, a + 1 + worst), (a + 1 + worst, b)]
        else:
            gaps.append((gap[worst], a + 1 + worst))
    for _, place in sorted(gaps, reverse=True):
        if keep.sum() - 2 >= least:
            break
        keep[place] = True
    return points[keep]


def thinned_arcs(found: DataFrame, tolerance: float) -> DataFrame:
    """Arcs with fewer points, each simplified once, for both its neighbours."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column("points").flatten(), batch.column("points").offsets.to_numpy()
            xy = np.column_stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)])
            ends = ends - ends[0]
            kept = [thinned(xy[a:b], tolerance, twin) for a, b, twin in zip(ends, ends[1:], batch.column("twin").to_pylist(), strict=False)]
            all_points = np.concatenate(kept) if kept else np.empty((0, 2))
            points = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(all_points[:, 0]), pa.array(all_points[:, 1])], ["x", "y"]))
            yield pa.RecordBatch.from_arrays([points if n == "points" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return found.mapInArrow(run, found.schema)


def from_arcs(found: DataFrame, key: str) -> DataFrame:
    """`key`, part, geom: the polygons on both sides of the arcs (a, b, points), put together again."""
    steps = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.element_at("points", i).alias("p"), F.element_at("points", i + 1).alias("q")))
    rows = found.select("a", "b", F.explode(steps).alias("s"))
    sides = rows.select(F.col("a").alias(key), "s.p", "s.q").unionByName(rows.filter("b is not null").select(F.col("b").alias(key), F.col("s.q").alias("p"), F.col("s.p").alias("q")))
    return parts(stitched(sides, [key]), [key])


def simplified(polygons: DataFrame, key: str, tolerance: float, digits: int = 3) -> DataFrame:
    """`key`, part, geom: polygons that cover an area without overlap, with fewer points: neighbours keep their common borders.

    Borders are simplified by themselves, so two that run closer beside each other than
    `tolerance` may come to cross.
    """
    return from_arcs(thinned_arcs(arcs(directed_sides(polygons, [key], digits), key), tolerance), key)


def neighbours(sides: DataFrame, key: str) -> DataFrame:
    """u, v: keys (u < v) with a side (key, p, q) in common."""
    low, high = F.least("p", "q"), F.greatest("p", "q")
    a, b = sides.select(F.col(key).alias("u"), low.alias("l"), high.alias("h")), sides.select(F.col(key).alias("v"), low.alias("l"), high.alias("h"))
    return a.join(b, ["l", "h"]).filter("u < v").select("u", "v").distinct()
