"""Polygons of real sizes and shapes: signs, covers, dissolving, and simplifying with neighbours kept."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from planweave.functions import geometry
from planweave.operators import outline, spatial



def box(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def frame(spark, rows, key="id"):
    return spark.createDataFrame(rows, f"{key} long, geom {geometry.POLYGON}")


def ring_set(rings):
    """Rings whatever corner they begin at."""
    def turned(r):
        pts = [(p.x, p.y) for p in r]
        i = pts.index(min(pts))
        return tuple(pts[i:] + pts[:i])

    return sorted(turned(r) for r in rings)


def test_a_thousand_rings(spark):
    """Islands and lakes of 100 corners each: near-linear, with the right signs."""
    circle = lambda x, y, r: [(x + r * math.cos(2 * math.pi * i / 100), y + r * math.sin(2 * math.pi * i / 100)) for i in range(100)]
    rings = [circle(10.0 * (i % 25), 10.0 * (i // 25), r) for i in range(500) for r in (4.0, 2.0)]
    shapes = frame(spark, [(1, rings)]).cache()
    shapes.count()
    began = time.perf_counter()
    got = shapes.select(geometry.area(F.col("geom")).alias("a"), geometry.centroid(F.col("geom")).alias("c")).first()
    took = time.perf_counter() - began
    one = 50 * math.sin(2 * math.pi / 100)
    assert abs(got.a - 500 * one * (16 - 4)) < 1e-6 and abs(got.c.x - 120) < 1e-6 and abs(got.c.y - 95) < 1e-6
    assert took < 10
    shapes.unpersist()


def test_signs_of_nested_rings_that_touch(spark):
    rings = [box(0.0, 0.0, 10.0), box(0.0, 0.0, 4.0), box(2.0, 2.0, 2.0), box(20.0, 0.0, 1.0)]  # a hole in the corner, an island that touches the hole
    got = frame(spark, [(1, rings), (2, []), (3, None)]).select("id", geometry.area(F.col("geom")).alias("a"), geometry.centroid(F.col("geom"))["x"].alias("x")).collect()
    by = {r.id: r for r in got}
    assert by[1].a == 100 - 16 + 4 + 1 and by[2].a == 0 and by[2].x is None and by[3].a is None
    point = frame(spark, [(1, [[(0.0, 0.0), (4.0, 0.0), (1.0, 1.0), (0.0, 4.0)]]), (2, [[(0.0, 0.0), (1.0, 0.0)]])]).select("id", geometry.inner_point(F.col("geom")[0]).alias("p"), F.col("geom")).collect()
    assert 0 < point[0].p.x < 4 and 0 < point[0].p.y < 1 and point[1].p is None


def test_cover_equals_the_plain_test(spark):
    random.seed(4)
    star = [(100 + (30 + 60 * (i % 2)) * math.cos(i / 40 * math.pi), 100 + (30 + 60 * (i % 2)) * math.sin(i / 40 * math.pi)) for i in range(80)]
    shapes = [(1, [star]), (2, [box(-50.0, -50.0, 90.0), box(-20.0, -20.0, 30.0), box(-10.0, -10.0, 5.0)]), (3, [box(128.0, 128.0, 64.0)]), (4, None), (5, []), (6, [[(0.0, 0.0), (1.0, 0.0)]])]
    spots = [(i, random.uniform(-60, 200), random.uniform(-60, 200)) for i in range(900)]
    spots += [(i + 900, float(random.randint(-50, 200)), float(random.randint(-50, 200))) for i in range(600)]  # on sides and corners too
    points = spark.createDataFrame(spots, "p long, x double, y double")
    polygons = frame(spark, shapes)
    told = sorted((r.p, r.id) for r in points.crossJoin(polygons.filter("geom is not null")).filter(geometry.within(F.col("x"), F.col("y"), F.col("geom"))).collect())
    for most in (1, 1000):
        got = spatial.points_in_polygons(points, polygons, "id", most=most)
        assert sorted((r.p, r.id) for r in got.collect()) == told and got.columns == ["p", "x", "y", "id"]
    left = spatial.points_in_polygons(points, polygons, "id", "left").collect()
    assert sorted((r.p, r.id) for r in left if r.id is not None) == told
    assert {r.p for r in left} == set(range(1500))
    cells = spatial.cover(polygons, ["id"], 8).collect()
    assert all(len(c.sides) <= 8 for c in cells if c.level > min(x.level for x in cells)) and any(c.inside and not c.sides for c in cells)


def test_one_large_polygon_and_many_points(spark):
    n = 100_000
    shapes = spark.range(1).select(F.col("id"), F.array(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((F.cos(i * 2 * math.pi / n) * (1000 + 20 * F.sin(i * 0.05))).alias("x"), (F.sin(i * 2 * math.pi / n) * (1000 + 20 * F.sin(i * 0.05))).alias("y")))).alias("geom"))
    points = spark.range(1_000_000).select("id", (F.rand(1) * 2400 - 1200).alias("x"), (F.rand(2) * 2400 - 1200).alias("y")).withColumnRenamed("id", "p")
    began = time.perf_counter()
    inside = spatial.points_in_polygons(points, shapes, "id").count()
    took = time.perf_counter() - began
    assert abs(inside / 1e6 - math.pi * (1000**2 + 200) / 2400**2) < 0.002
    assert took < 90


@pytest.mark.parametrize("local", [outline.LOCAL, 0, 12])
def test_dissolve_with_holes_islands_and_corners_that_touch(spark, monkeypatch, local):
    monkeypatch.setattr(outline, "LOCAL", local)  # walked around in tasks, or linked and ranked, or some of each
    cells = {(x, y): 1 for x in range(7) for y in range(7)}
    for hole in ((1, 1), (2, 2), (4, 4), (5, 4)):  # two that touch at a corner, two that are one hole
        del cells[hole]
    for x, y in ((20, 0), (21, 1)):  # two parts that touch at a corner
        cells[x, y] = 1
    cells[2, 2] = 2  # another group in the hole
    rows = [(100 * x + y, [box(10.0 * x, 10.0 * y, 10.0)][:: 1 if (x + y) % 2 else -1]) for x, y in cells]
    owners = spark.createDataFrame([(100 * x + y, g) for (x, y), g in cells.items()], "id long, g int")
    found = outline.dissolved(frame(spark, rows), owners, "id", ["g"])
    parts = {(r.g, len(r.geom), ring_set([r.geom[0]])[0][0]) for r in found.collect()}
    assert parts == {(1, 4, (0.0, 0.0)), (1, 1, (200.0, 0.0)), (1, 1, (210.0, 10.0)), (2, 1, (20.0, 20.0))}
    told = {r.g: r for r in outline.measures(found, ["g"]).collect()}
    assert told[1].area_m2 == 100.0 * (49 - 4 + 2) and told[1].holes == 3 and told[1].parts == 3 and told[2].area_m2 == 100
    big = next(r for r in found.collect() if len(r.geom) == 4)
    assert ring_set(big.geom[1:]) == ring_set_of([[(10.0, 10.0), (10.0, 20.0), (20.0, 20.0), (20.0, 10.0)], [(20.0, 20.0), (20.0, 30.0), (30.0, 30.0), (30.0, 20.0)], [(40.0, 40.0), (40.0, 50.0), (50.0, 50.0), (60.0, 50.0), (60.0, 40.0), (50.0, 40.0)]])
    merged = outline.whole(found, ["g"])
    assert {r.g: r.a for r in merged.select("g", geometry.area(F.col("geom")).alias("a")).collect()} == {1: 4700.0, 2: 100.0}


def ring_set_of(rings):
    return sorted(tuple(r[r.index(min(r)) :] + r[: r.index(min(r))]) for r in rings)


def clipped(subject, clip):
    """The part of a convex ring inside another convex ring, both counter-clockwise, by cutting at its sides."""
    out = subject
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        kept = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            if side(p) >= 0:
                kept.append(p)
            if side(p) * side(q) < 0:
                t = side(p) / (side(p) - side(q))
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = kept
        if not out:
            return 0.0
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(out, out[1:] + out[:1], strict=True)) / 2


def test_overlay_of_convex_shapes_against_cutting(spark):
    rng = random.Random(6)

    def convex(i):
        x, y, r, n = rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(10, 80), rng.randint(3, 12)
        return sorted(rng.uniform(0, 2 * math.pi) for _ in range(n)), x, y, r

    rings = [[(x + r * math.cos(t), y + r * math.sin(t)) for t in turns] for turns, x, y, r in map(convex, range(60))]
    ours, theirs = rings[:30], rings[30:]
    told = {(i, j): area for i, a in enumerate(ours) for j, b in enumerate(theirs) if (area := clipped(a, b)) > 1e-6}
    for width in (25.0, 1000.0):
        got = outline.overlay_areas(frame(spark, [(i, [r[::-1] if i % 2 else r]) for i, r in enumerate(ours)], "a"), frame(spark, [(i, [r]) for i, r in enumerate(theirs)], "b"), "a", "b", width)
        found = {(r.a, r.b): r.area_m2 for r in got.collect()}
        assert found.keys() == told.keys() and all(abs(found[k] - told[k]) < 1e-6 for k in told)


def test_overlay_with_holes_and_parts(spark):
    a = frame(spark, [(1, [box(0.0, 0.0, 100.0), box(20.0, 20.0, 20.0), box(200.0, 0.0, 10.0)]), (2, None), (3, [])], "a")
    b = frame(spark, [(7, [box(10.0, 10.0, 50.0)]), (8, [box(150.0, -50.0, 100.0)]), (9, [box(22.0, 22.0, 5.0)])], "b")
    got = {(r.a, r.b): round(r.area_m2, 6) for r in outline.overlay_areas(a, b, "a", "b", 30.0).collect()}
    assert got == {(1, 7): 2500.0 - 400.0, (1, 8): 100.0}
    same = outline.overlay_areas(a, a.withColumnRenamed("a", "b"), "a", "b", 7.0).collect()
    assert [(r.a, r.b, round(r.area_m2, 6)) for r in same] == [(1, 1, 10000.0 - 400 + 100)]


def test_ranking_of_chains_and_rings(spark):
    random.seed(9)
    links, told = [], {}
    at = 0
    for size, ring in ((1, True), (1, False), (7, True), (64, True), (100, False), (33, True)):
        ids = random.sample(range(at, at + size), size)
        at += size
        for i, a in enumerate(ids):
            after = ids[(i + 1) % size] if ring or i + 1 < size else None
            links.append((a, after))
            own = ids[-1] if not ring else min(ids)
            told[a] = (own, (ids.index(own) - i) % size)
    got = {r.id: (r.chain, r.ahead) for r in outline.ranked(spark.createDataFrame(links, "id long, next long")).collect()}
    assert got == told


def wobbly(n=6, seed=1, between=5):
    """A grid of polygons whose common borders are the same uneven lines."""
    rng = random.Random(seed)
    corner = {(i, j): (100.0 * i + rng.uniform(-20, 20), 100.0 * j + rng.uniform(-20, 20)) for i in range(n + 1) for j in range(n + 1)}
    lines = {}

    def line(a, b):
        if (a, b) not in lines:
            (x0, y0), (x1, y1) = corner[a], corner[b]
            inner = [(x0 + (x1 - x0) * k / between + rng.uniform(-6, 6), y0 + (y1 - y0) * k / between + rng.uniform(-6, 6)) for k in range(1, between)]
            lines[a, b] = [corner[a], *inner, corner[b]]
            lines[b, a] = lines[a, b][::-1]
        return lines[a, b]

    rows = []
    for i in range(n):
        for j in range(n):
            way = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1), (i, j)]
            rows.append((i * n + j, [[p for a, b in zip(way, way[1:], strict=False) for p in line(a, b)[:-1]]]))
    return rows


def test_neighbours_stay_neighbours(spark):
    rows = wobbly()
    island = [(250.0 + 8 * math.cos(k / 10 * math.pi), 250.0 + 8 * math.sin(k / 10 * math.pi)) for k in range(20)]
    at = next(i for i, (_, g) in enumerate(rows) if i == 14)
    rows[at] = (rows[at][0], [rows[at][1][0], island])  # a hole
    rows.append((99, [island]))  # and what lies in it
    shapes = frame(spark, rows)
    sides = outline.directed_sides(shapes, ["id"], 6)
    before = {(r.u, r.v) for r in outline.neighbours(sides, "id").collect()}
    whole = shapes.select("id", geometry.area(F.col("geom")).alias("a"), F.size(F.flatten(F.col("geom"))).alias("n"))
    for tolerance in (6.0, 1e9):
        found = outline.simplified(shapes, "id", tolerance, 6)
        after = {(r.u, r.v) for r in outline.neighbours(outline.directed_sides(found, ["id"], 6), "id").collect()}
        assert after == before and (14, 99) in before
        sizes = found.groupBy("id").agg(F.sum(geometry.area(F.col("geom"))).alias("b"), F.sum(F.size(F.flatten(F.col("geom")))).alias("m"))
        got = whole.join(sizes, "id").collect()
        assert len(got) == 37 and all(r.m <= r.n and r.m >= 3 for r in got)
        if tolerance < 1e9:  # nothing is lost or covered twice
            assert abs(sum(r.a for r in got) - sum(r.b for r in got)) / sum(r.a for r in got) < 0.02
    exact = outline.simplified(shapes, "id", 0.0, 6).select("id", geometry.area(F.col("geom")).alias("b")).join(whole, "id").collect()
    assert all(abs(r.a - r.b) < 1e-3 for r in exact)


def test_twins_and_closed_borders_keep_a_corner():
    import numpy as np

    line = np.array([(0.0, 0.0), (5.0, 0.1), (10.0, 0.0)])
    assert len(outline.thinned(line, 1.0, False)) == 2 and len(outline.thinned(line, 1.0, True)) == 3
    ring = np.array([(math.cos(i / 10 * math.pi), math.sin(i / 10 * math.pi)) for i in range(20)] + [(1.0, 0.0)])
    assert len(outline.thinned(ring, 100.0, False)) >= 4


def test_empty_tables(spark):
    none = frame(spark, [])
    assert outline.simplified(none, "id", 1.0).count() == 0
    assert outline.dissolved(none, spark.createDataFrame([], "id long, g int"), "id", ["g"]).count() == 0
    assert spatial.points_in_polygons(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), none, "id").count() == 0


def test_simple_loops():
    eight = [{"x": x, "y": y} for x, y in ((0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (1, 2), (1, 1), (0, 1))]
    loops = outline.simple_loops(eight)
    assert sorted(map(len, loops)) == [4, 4]
