"""Spatial joins by cells: equi-joins on a cell with the exact predicate beside.

Polygons are covered by cells of a quadtree that are small where the border is crowded and
large elsewhere. A cell that no side touches is wholly inside and needs no test; any other
holds the sides that touch it and whether one place in it is inside, and a point of that cell is
as far inside as the sides between it and that place say. So no row carries a polygon.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions import geometry
from planweave.session import stored

#: Sides that a cell may hold before it is parted, and how often a first cell is parted at most.
SIDES, DEPTH = 24, 14
#: Partings before cells are dealt out anew, the sides of one that is worth it, and the cells that a task has at a time.
SPREAD, DEALT, CELLS = 4, 1000, 1024
# Where in a cell its place is, as shares of its side: off every grid that data lie on.
ACROSS, UP = 0.38196601125010515, 0.6180339887498949


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _touching(sides: np.ndarray, x0: float, y0: float, size: float) -> np.ndarray:
    """Marks of the sides (rows of ax, ay, bx, by) that come into a closed cell."""
    ax, ay, bx, by = sides.T
    boxed = (np.minimum(ax, bx) <= x0 + size) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y0 + size) & (np.maximum(ay, by) >= y0)
    dx, dy = bx - ax, by - ay
    corners = np.array([dx * (y - ay) - dy * (x - ax) for x, y in ((x0, y0), (x0 + size, y0), (x0 + size, y0 + size), (x0, y0 + size))])
    slack = 1e-9 * size * (np.abs(dx) + np.abs(dy))
    return boxed & (corners.min(axis=0) <= slack) & (corners.max(axis=0) >= -slack)


def _turns(sides: np.ndarray, x0: float, y0: float, x: float, y: float) -> bool:
    """Whether the way from (x0, y0), first up or down and then across, to (x, y) meets an odd number of sides."""
    ax, ay, bx, by = sides.T
    with np.errstate(divide="ignore", invalid="ignore"):
        up = ((ax > x0) != (bx > x0)) & (((at := ay + (x0 - ax) * (by - ay) / (bx - ax)) > y0) != (at > y))
        over = ((ay > y) != (by > y)) & (((at := ax + (y - ay) * (bx - ax) / (by - ay)) > x0) != (at > x))
    return bool((int(up.sum()) + int(over.sum())) % 2)


def _place(level: int, cx: int, cy: int) -> tuple[float, float]:
    size = 2.0**level
    return (cx + ACROSS) * size, (cy + UP) * size


Cell = tuple[int, int, int, bool, np.ndarray]


def _roots(sides: np.ndarray) -> Iterator[Cell]:
    """The cells, as wide as a polygon, that it lies in."""
    xs, ys = sides[:, ::2], sides[:, 1::2]
    x0, y0, x1, y1 = xs.min(), ys.min(), xs.max(), ys.max()
    level = math.ceil(math.log2(max(x1 - x0, y1 - y0, 1e-9)))
    size = 2.0**level
    for cx in range(math.floor(x0 / size), math.floor(x1 / size) + 1):
        for cy in range(math.floor(y0 / size), math.floor(y1 / size) + 1):
            x, y = _place(level, cx, cy)
            inside = _turns(sides, x, y0 - size, x, y)  # from below the polygon, where nothing is inside
            held = sides[_touching(sides, cx * size, cy * size, size)]
            if inside or len(held):
                yield level, cx, cy, inside, held


def _quarters(cell: Cell) -> Iterator[Cell]:
    level, cx, cy, inside, sides = cell
    here, size = _place(level, cx, cy), 2.0 ** (level - 1)
    for x, y in ((2 * cx, 2 * cy), (2 * cx + 1, 2 * cy), (2 * cx, 2 * cy + 1), (2 * cx + 1, 2 * cy + 1)):
        within = inside != _turns(sides, *here, *_place(level - 1, x, y))
        held = sides[_touching(sides, x * size, y * size, size)]
        if within or len(held):
            yield level - 1, x, y, within, held


def _sides_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sides of rings of points, the last joined to the first."""
    after = np.roll(points, -1, axis=0)
    for a, b in zip(ends, ends[1:], strict=False):
        if b > a:
            after[b - 1] = points[a]
    sides = np.hstack([points, after])
    return sides[(sides[:, :2] != sides[:, 2:]).any(axis=1)]


_SIDE = "struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>"


def _as_arrow(batch: pa.RecordBatch, keys: int, found: Sequence[tuple[int, Cell, int]]) -> pa.RecordBatch:
    """Rows of (row of the batch, cell, partings left) with that row's keys."""
    rows, cells, left = zip(*found, strict=True) if found else ((), (), ())
    taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:keys]]
    flat = np.concatenate([c[4] for c in cells]) if cells else np.empty((0, 4))
    point = lambda i: pa.StructArray.from_arrays([pa.array(flat[:, i]), pa.array(flat[:, i + 1])], ["x", "y"])
    sides = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(c[4]) for c in cells)]).astype(np.int32)), pa.StructArray.from_arrays([point(0), point(2)], ["a", "b"]))
    numbers = [pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int64()), pa.array([c[2] for c in cells], pa.int64()), pa.array([c[3] for c in cells], pa.bool_())]
    return pa.RecordBatch.from_arrays([*taken, *numbers, sides, pa.array(left, pa.int32())], [*batch.schema.names[:keys], "level", "cx", "cy", "inside", "sides", "left"])


def cover(polygons: DataFrame, keys: list[str], most: int = SIDES, depth: int = DEPTH) -> DataFrame:
    """`keys`, level, cx, cy, inside, sides: the cells, 2^level wide, of every polygon (geom), none over another.

    At first there are the four cells or fewer, as wide as the polygon, that it lies in; then
    those with more than `most` sides are parted in four, `depth` times at most. After SPREAD times
    the ones that still have more than DEALT sides are dealt out anew, so a large polygon is soon
    many tasks'; smaller ones cost less to part than to send. Every parting goes by the cell's own
    sides. Cells without sides are only kept if they are inside.
    """
    n = len(keys)

    def parted(batch: pa.RecordBatch, row: int, cells: Iterable[Cell], left: int) -> Iterator[tuple[int, Cell, int]]:
        todo = [(c, left, SPREAD) for c in cells]
        while todo:
            cell, left, now = todo.pop()
            if len(cell[4]) <= most or not left or now <= 0 and len(cell[4]) > DEALT:
                yield row, cell, left if len(cell[4]) > most else 0
            else:
                todo += [(c, left - 1, now - 1) for c in _quarters(cell)]

    def sent(batch: pa.RecordBatch, row: int, cells: Iterable[Cell], left: int) -> Iterator[pa.RecordBatch]:
        for some in batched(parted(batch, row, cells, left), CELLS):
            yield _as_arrow(batch, n, some)

    def begin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rings = batch.column(n).slice(row, 1).flatten()
                points = rings.flatten()
                xy = np.column_stack([points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)])
                ends = np.cumsum([0, *rings.value_lengths().to_pylist()])
                sides = _sides_of(xy, ends)
                if len(sides):
                    yield from sent(batch, row, _roots(sides), depth)

    def go_on(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = {c: batch.column(c).to_pylist() for c in ("level", "cx", "cy", "inside", "left")}
            for row in range(batch.num_rows):
                held = batch.column("sides").slice(row, 1).flatten()
                sides = np.column_stack([held.field(e).field(c).to_numpy(zero_copy_only=False) for e in "ab" for c in "xy"])
                cell = tuple(plain[c][row] for c in ("level", "cx", "cy", "inside")) + (sides,)
                yield from sent(batch, row, [cell], plain["left"][row])

    schema = ", ".join([*(f"`{k}` {polygons.schema[k].dataType.simpleString()}" for k in keys), f"level int, cx long, cy long, inside boolean, sides array<{_SIDE}>, left int"])
    cells = stored(polygons.filter("geom is not null").select(*keys, "geom").mapInArrow(begin, schema), "cover")
    done = cells.filter("left = 0")
    while not (more := cells.filter("left > 0")).isEmpty():
        cells = stored(more.repartition(*keys, "level", "cx", "cy").mapInArrow(go_on, schema), "cover")
        done = done.unionByName(cells.filter("left = 0"))
    return done.drop("left")


def _bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells whose sides are the bytes of their ax, ay, bx, by, as many points meet a cell and structs are slow to send."""
    for batch in batches:
        held, at = batch.column("sides"), batch.schema.get_field_index("sides")
        flat, ends = held.flatten(), np.append(0, held.value_lengths().to_numpy(zero_copy_only=False).cumsum()) * 32
        sides = np.column_stack([flat.field(e).field(c).to_numpy(zero_copy_only=False) for e in "ab" for c in "xy"])
        sent = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(sides.tobytes())])
        yield batch.set_column(at, "sides", sent)


def in_cell(batch: pa.RecordBatch) -> np.ndarray:
    """Marks of the points (x, y) that are strictly inside the polygon of their cell of `cover` (sides as `_bytes`): one on a side is out."""
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    size, inside, held = np.exp2(column("level").astype(float)), column("inside").astype(bool), batch.column("sides").cast(pa.binary())
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset :][: batch.num_rows + 1] if batch.num_rows else np.zeros(1, np.int32)
    row = np.arange(batch.num_rows).repeat(np.diff(ends) // 32)
    ax, ay, bx, by = np.frombuffer(held.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.float64).reshape(-1, 4).T
    x, y, x0, y0 = (v[row] for v in (column("x").astype(float), column("y").astype(float), (column("cx") + ACROSS) * size, (column("cy") + UP) * size))
    with np.errstate(divide="ignore", invalid="ignore"):
        up = ((ax > x0) != (bx > x0)) & (((at := ay + (x0 - ax) * (by - ay) / (bx - ax)) > y0) != (at > y))
        over = ((ay > y) != (by > y)) & (((at := ax + (y - ay) * (bx - ax) / (by - ay)) > x0) != (at > x))
    on = ((bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0) & (x >= np.minimum(ax, bx)) & (x <= np.maximum(ax, bx)) & (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by))
    turns = np.bincount(row[up], minlength=batch.num_rows) + np.bincount(row[over], minlength=batch.num_rows)
    return (inside != (turns % 2 == 1)) & (np.bincount(row[on], minlength=batch.num_rows) == 0)


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, how: str = "inner", on: tuple[str, ...] = (), most: int = SIDES) -> DataFrame:
    """points (x, y, ...) with `key` of every polygon (geom) that they are strictly inside of; with `on`, only of those that have these columns in common.

    A point is looked for once a level that there are cells of, by equi-joins, and a polygon's
    cells aren't over each other, so no pair comes up twice. With `how` "left" points inside nothing stay, with a null.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    cells = cover(polygons, [key, *on], most)
    levels = [r.level for r in cells.select("level").distinct().collect()]  # no more than there are exponents
    named = {c: f"_p_{c}" for c in on}
    if how == "left":
        points = stored(points.withColumn("_row", F.monotonically_increasing_id()), "points")
    spots = points.withColumnsRenamed(named).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", F.pow(F.lit(2.0), F.col("_level")))
    spots = spots.withColumn("_cx", F.floor(F.col("x") / F.col("_cell"))).withColumn("_cy", F.floor(F.col("y") / F.col("_cell")))
    same = (F.col("level") == F.col("_level")) & (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy"))
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(named[c]))
    sent = cells.mapInArrow(_bytes, ", ".join("sides binary" if f.name == "sides" else f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema))
    near = spots.join(sent, same).drop("_level", "_cell", "_cx", "_cy", *named.values())
    if how == "left":
        near = near.select("_row", "x", "y", key, "level", "cx", "cy", "inside", "sides")
    kept = near.drop("level", "cx", "cy", "inside", "sides").schema
    names = kept.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(names).filter(pa.array(in_cell(batch)))

    met = near.mapInArrow(run, kept)
    return points.join(met.select("_row", key), "_row", "left").drop("_row") if how == "left" else met


def first_match(joined: DataFrame, key: str, order: str) -> DataFrame:
    """One row a `key`: the first in the layer's order."""
    return joined.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last()))).filter("_n = 1").drop("_n")


def centres_within(areas: DataFrame, regions: DataFrame, key: str, region: str) -> DataFrame:
    """`key` of every area (geom) and the first `region` (geom) that its centre is strictly inside of; null outside all."""
    centre = areas.select(key, geometry.centroid(F.col("geom")).alias("c")).select(key, F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    return first_match(points_in_polygons(centre, regions, region, "left"), key, region).select(key, region)


def near_lines(segments: DataFrame, lines: DataFrame, keys: list[str], radius: float, size: float) -> DataFrame:
    """`keys` of the segments (x0, y0, x1, y1) that come within `radius` of any line segment.

    Only the segments' cells are widened by the radius, so each meeting is found in some common cell.
    """

    def tiled(rows: DataFrame, by: float) -> DataFrame:
        x = _cells(F.least("x0", "x1") - by, F.greatest("x0", "x1") + by, size)
        y = _cells(F.least("y0", "y1") - by, F.greatest("y0", "y1") + by, size)
        return rows.withColumn("cx", F.explode(x)).withColumn("cy", F.explode(y))

    a, b = tiled(segments, radius).alias("a"), tiled(lines.select("x0", "y0", "x1", "y1"), 0.0).alias("b")
    ends = lambda t: tuple(F.col(f"{t}.{c}") for c in ("x0", "y0", "x1", "y1"))
    close = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (geometry.segment_distance(ends("a"), ends("b")) <= radius)
    return a.join(b, close, "left_semi").select(*keys).distinct()
