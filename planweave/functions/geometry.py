"""Planar geometry on arrays of points: a ring is array<struct<x,y>>, a polygon an array of rings.

A ring inside an odd number of the others is a hole, whichever way it turns; the others
are outside, so a polygon may have any number of parts, and islands in its lakes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
POLYGON = f"array<{RING}>"


def segments(ring: Column) -> Column:
    """Consecutive points in pairs, the last joined to the first."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.filter(F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["a"] != s["b"])


def _cross(s: Column) -> Column:
    return s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]


def _length(s: Column) -> Column:
    return F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def ring_area(ring: Column) -> Column:
    return F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + _cross(s)) / 2


def inner_point(ring: Column) -> Column:
    """A point strictly inside a ring: halfway between its lowest two heights, between the first two sides there. Null without an area."""
    heights = lambda r: F.transform(r, lambda p: p["y"])

    def at(ys: Column) -> Column:
        low = F.array_min(ys)
        return (low + F.array_min(F.filter(ys, lambda y: y > low))) / 2

    def across(y: Column) -> Column:
        met = F.filter(segments(ring), lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y))
        return F.array_sort(F.transform(met, lambda s: s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / (s["b"]["y"] - s["a"]["y"])))

    return _let(_let(heights(ring), at), lambda y: _let(across(y), lambda xs: F.when(F.size(xs) >= 2, F.struct(((F.get(xs, F.lit(0)) + F.get(xs, F.lit(1))) / 2).alias("x"), y.alias("y")))))


def _odd_around(x: Column, y: Column, ring: Column) -> Column:
    met = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & F.coalesce(x < s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)), F.lit(False))
    return F.size(F.filter(segments(ring), met)) % 2 == 1


def _told(polygon: Column) -> Column:
    """Every ring with its area and `around`: area and place of all rings that it lies in.

    A ring is only held against larger ones whose box is around its own, and then by one
    point inside it, so many rings beside each other cost a comparison of boxes each.
    """
    told = lambda r, i: F.struct(r.alias("ring"), i.alias("place"), F.abs(ring_area(r)).alias("area"), bounds(F.array(r)).alias("box"), inner_point(r).alias("at"))

    def holds(o: Column, r: Column) -> Column:
        box, own = o["box"], r["box"]
        boxed = (box["x0"] <= own["x0"]) & (box["y0"] <= own["y0"]) & (box["x1"] >= own["x1"]) & (box["y1"] >= own["y1"])
        return F.coalesce((o["area"] > r["area"]) & boxed & _odd_around(r["at"]["x"], r["at"]["y"], o["ring"]), F.lit(False))

    around = lambda rings, r: F.transform(F.filter(rings, lambda o: holds(o, r)), lambda o: F.struct(o["area"].alias("area"), o["place"].alias("place")))
    return _let(F.transform(polygon, told), lambda rings: F.transform(rings, lambda r: F.struct(r["ring"].alias("ring"), r["place"].alias("place"), around(rings, r).alias("around"))))


def _signs(polygon: Column) -> Column:
    """1 for outer rings, -1 for holes: by how many other rings a ring lies in."""
    signs = F.transform(_told(polygon), lambda r: F.when(F.size(r["around"]) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0)))
    return F.when(F.size(polygon) <= 1, F.transform(polygon, lambda _: F.lit(1.0))).otherwise(signs)


def nested(polygon: Column) -> Column:
    """The parts of a polygon: each outer ring and then the holes that lie in it and in nothing smaller."""
    hole = lambda r: F.size(r["around"]) % 2 == 1
    own = lambda rings, o: F.transform(F.filter(rings, lambda r: hole(r) & (F.array_min(r["around"])["place"] == o["place"])), lambda r: r["ring"])
    return _let(_told(polygon), lambda rings: F.transform(F.filter(rings, lambda r: ~hole(r)), lambda o: F.concat(F.array(o["ring"]), own(rings, o))))


def _moments(ring: Column) -> Column:
    """Area and its moments about the axes, without a sign."""
    sums = F.aggregate(
        segments(ring),
        F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda t, s: F.struct((t["a"] + _cross(s)).alias("a"), (t["x"] + (s["a"]["x"] + s["b"]["x"]) * _cross(s)).alias("x"), (t["y"] + (s["a"]["y"] + s["b"]["y"]) * _cross(s)).alias("y")),
        lambda t: F.struct((t["a"] / 2).alias("a"), (t["x"] / 6).alias("x"), (t["y"] / 6).alias("y")),
    )
    return _let(sums, lambda m: F.struct(*((m[c] * F.when(m["a"] < 0, -1.0).otherwise(1.0)).alias(c) for c in ("a", "x", "y"))))


def area(polygon: Column) -> Column:
    """Shoelace area: all outer rings' less the holes'."""
    sizes = F.zip_with(polygon, _signs(polygon), lambda r, s: F.abs(ring_area(r)) * s)
    return F.aggregate(sizes, F.lit(0.0), lambda t, a: t + a)


def oriented(polygon: Column) -> Column:
    """The same rings, outer ones counter-clockwise and holes clockwise: what is inside lies to the left."""
    return F.zip_with(polygon, _signs(polygon), lambda r, s: F.when((ring_area(r) < 0) != (s < 0), F.reverse(r)).otherwise(r))


def perimeter(polygon: Column) -> Column:
    return F.aggregate(F.flatten(F.transform(polygon, segments)), F.lit(0.0), lambda t, s: t + _length(s))


def centroid(polygon: Column) -> Column:
    """Centre of the area of all parts, holes left out; null without an area."""
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("a", "x", "y")))
    each = F.zip_with(F.transform(polygon, _moments), _signs(polygon), lambda m, s: F.struct(*((m[c] * s).alias(c) for c in ("a", "x", "y"))))
    whole = F.aggregate(each, zero, lambda t, m: F.struct(*((t[c] + m[c]).alias(c) for c in ("a", "x", "y"))))
    return _let(whole, lambda t: F.struct(F.try_divide(t["x"], t["a"]).alias("x"), F.try_divide(t["y"], t["a"]).alias("y")))


def within(x: Column, y: Column, polygon: Column) -> Column:
    """Strictly inside: a point on any ring is out."""
    rings = F.flatten(F.transform(polygon, segments))

    def on(s: Column) -> Column:
        turn = (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (x - s["a"]["x"])
        along = lambda c, v: (v >= F.least(s["a"][c], s["b"][c])) & (v <= F.greatest(s["a"][c], s["b"][c]))
        return (turn == 0) & along("x", x) & along("y", y)

    def crosses(s: Column) -> Column:
        at = s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0))
        return ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & F.coalesce(x < at, F.lit(False))

    return ~F.exists(rings, on) & (F.size(F.filter(rings, crosses)) % 2 == 1)


def well_known_text(polygon: Column) -> Column:
    """MULTIPOLYGON text, rings closed, each part's holes after its outer ring. Null and empty are null."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    closed = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(closed(r), point), ", "), F.lit(")"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    return F.when(F.size(polygon) > 0, F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(nested(polygon), part), ", "), F.lit(")")))


def bounds(polygon: Column) -> Column:
    points = F.flatten(polygon)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def segment_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The least distance of two segments, each given as x0, y0, x1, y1."""

    def to(px: Column, py: Column, s: tuple[Column, ...]) -> Column:
        dx, dy = s[2] - s[0], s[3] - s[1]
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((px - s[0]) * dx + (py - s[1]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(px - s[0] - t * dx, py - s[1] - t * dy)

    def side(s: tuple[Column, ...], px: Column, py: Column) -> Column:
        return F.signum((s[2] - s[0]) * (py - s[1]) - (s[3] - s[1]) * (px - s[0]))

    meet = (side(a, b[0], b[1]) * side(a, b[2], b[3]) < 0) & (side(b, a[0], a[1]) * side(b, a[2], a[3]) < 0)
    return F.when(meet, F.lit(0.0)).otherwise(F.least(to(b[0], b[1], a), to(b[2], b[3], a), to(a[0], a[1], b), to(a[2], a[3], b)))


# Standard parallels, origin and ellipsoid (GRS 80) of the two Albers projections; the UTM zones' central meridians.
A, INVERSE_FLATTENING = 6378137.0, 298.257222101
ALBERS = {"EPSG:5070": (29.5, 45.5, 23.0, -96.0), "EPSG:3338": (55.0, 65.0, 50.0, -154.0)}
UTM = {"EPSG:26904": -159.0, "EPSG:32618": -75.0}


def projected(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """Metres east and north of geographic degrees."""
    f = 1 / INVERSE_FLATTENING
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    if crs in ALBERS:
        p1, p2, p0, l0 = (math.radians(v) for v in ALBERS[crs])
        q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))
        m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
        q0, q1, q2 = (float(q_of(math.sin(p))) for p in (p0, p1, p2))
        n = (m(p1) ** 2 - m(p2) ** 2) / (q2 - q1)
        c = m(p1) ** 2 + n * q1
        s = F.sin(F.radians(lat))
        q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho, rho0, theta = A * F.sqrt(c - n * q) / n, A * math.sqrt(c - n * q0) / n, n * (F.radians(lon) - l0)
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)
    l0, k0, ep2, p = math.radians(UTM[crs]), 0.9996, e2 / (1 - e2), F.radians(lat)
    v, t, c = A / F.sqrt(1 - e2 * F.sin(p) ** 2), F.tan(p) ** 2, ep2 * F.cos(p) ** 2
    a = (F.radians(lon) - l0) * F.cos(p)
    arc = A * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * p) - (35 * e2**3 / 3072) * F.sin(6 * p))
    x = k0 * v * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * a**5 / 120) + 500000.0
    y = k0 * (arc + v * F.tan(p) * (a**2 / 2 + (5 - t + 9 * c + 4 * c**2) * a**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * a**6 / 720))
    return x, y


def unprojected(x: Column, y: Column, crs: str, rounds: int = 8) -> tuple[Column, Column]:
    """Geographic degrees of metres east and north: what `projected` takes there, to less than a millimetre, by fixed-point rounds."""
    f = 1 / INVERSE_FLATTENING
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    turns = F.sequence(F.lit(1), F.lit(rounds))
    if crs in ALBERS:
        p1, p2, p0, l0 = (math.radians(v) for v in ALBERS[crs])
        q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
        m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
        q0, q1, q2 = (q_of(math.sin(p)) for p in (p0, p1, p2))
        n = (m(p1) ** 2 - m(p2) ** 2) / (q2 - q1)
        c = m(p1) ** 2 + n * q1
        down = A * math.sqrt(c - n * q0) / n - y
        q = (c - (x * x + down * down) * n * n / (A * A)) / n

        def nearer(p: Column) -> Column:
            s = F.sin(p)
            w = 1 - e2 * s * s
            return p + w * w / (2 * F.cos(p)) * (q / (1 - e2) - s / w + F.log((1 - e * s) / (1 + e * s)) / (2 * e))

        lat = F.aggregate(turns, F.asin(q / 2), lambda p, _: nearer(p))
        return F.degrees(l0 + F.atan2(x, down) / n), F.degrees(lat)
    first = F.struct(F.lit(UTM[crs]).alias("lon"), F.degrees(y / (0.9996 * A)).alias("lat"))

    def closer(at: Column) -> Column:
        east, north = projected(at["lon"], at["lat"], crs)
        s = F.sin(F.radians(at["lat"]))
        w = 1 - e2 * s * s
        wide, high = 0.9996 * A / F.sqrt(w) * F.cos(F.radians(at["lat"])), 0.9996 * A * (1 - e2) / (w * F.sqrt(w))
        return F.struct((at["lon"] + F.degrees((x - east) / wide)).alias("lon"), (at["lat"] + F.degrees((y - north) / high)).alias("lat"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(2 * rounds)), first, lambda at, _: closer(at))
    return found["lon"], found["lat"]


def reprojected(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """A place in one projection as it is in another."""
    return projected(*unprojected(x, y, source), target)


def reprojected_polygon(polygon: Column, source: str, target: str) -> Column:
    point = lambda p: F.struct(*(c.alias(n) for n, c in zip("xy", reprojected(p["x"], p["y"], source, target), strict=True)))
    return F.transform(polygon, lambda r: F.transform(r, point))


def simplified_ring(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points that stay when those within `tolerance` of the line between kept neighbours go; the ends of the two farthest-apart halves stay."""
    if len(points) < 4:
        return points
    far = int(np.hypot(*(points - points[0]).T).argmax())
    keep = np.zeros(len(points) + 1, bool)
    keep[[0, far, len(points)]] = True
    closed, todo = np.vstack([points, points[:1]]), [(0, far), (far, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        along, off = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        part = np.clip(off @ along / max(along @ along, 1e-300), 0, 1)
        gap = np.hypot(*(off - part[:, None] * along).T)
        worst = int(gap.argmax())
        if gap[worst] > tolerance:
            keep[a + 1 + worst] = True
            todo += [(a, a + 1 + worst), (a + 1 + worst, b)]
    kept = points[keep[:-1]]
    return kept if len(kept) > 2 else points


def simplified(polygons: DataFrame, tolerance: float) -> DataFrame:
    """`geom` with fewer points, ring by ring; rings that would vanish stay as they are."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rings = frame["geom"].map(lambda g: None if g is None else [[{"x": x, "y": y} for x, y in simplified_ring(np.array([(p["x"], p["y"]) for p in r]), tolerance)] for r in g])
            yield frame.assign(geom=rings)

    return polygons.mapInPandas(run, polygons.schema)
