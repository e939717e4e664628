"""Map files: what isn't read of them, GeoPackages there and back, and what a failed write leaves."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F
from test_fixtures import polygons, square, write_shapefile

from planweave.functions import geometry
from planweave.sources import geopackage, pruning, shapefile


class Counting:
    """A store that counts what is read of its files."""

    def __init__(self, store):
        self.store, self.read = store, 0

    def __getattr__(self, name):
        return getattr(self.store, name)

    def open_input_file(self, path):
        outer, held = self, self.store.open_input_file(path)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                held.close()

            def read(self, n):
                outer.read += n
                return held.read(n)

            def read_at(self, n, at):
                outer.read += n
                return held.read_at(n, at)

        return File()


def with_boxes(base, shapes):
    """`write_shapefile` leaves the records' boxes empty; put them in."""
    path = base.parent / (base.name + ".shp")
    whole, at = bytearray(path.read_bytes()), 100
    for s in shapes:
        (length,) = struct.unpack_from(">i", whole, at + 4)
        if s is not None:
            xs, ys = [p[0] for r in s for p in r], [p[1] for r in s for p in r]
            struct.pack_into("<4d", whole, at + 12, min(xs), min(ys), max(xs), max(ys))
        at += 8 + 2 * length
    path.write_bytes(bytes(whole))


def many(n=40, corners=500):
    import math

    return [[[(100.0 * i + 40 * math.cos(2 * math.pi * k / corners), 40 * math.sin(2 * math.pi * k / corners)) for k in range(corners)]] for i in range(n)]


def test_a_box_reads_fewer_bytes(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual
    from pyspark.sql.types import StructType

    shapes = many()
    write_shapefile(tmp_path / "a", shapes)
    with_boxes(tmp_path / "a", shapes)
    counted = []
    plain = shapefile._store
    monkeypatch.setattr(shapefile, "_store", lambda path: (counted.append(Counting(plain(path)[0])) or counted[-1], plain(path)[1]))
    options = {"path": str(tmp_path), "parts": "1", "push": "true"}
    schema = StructType.fromDDL(shapefile.Shapefile(options).schema())

    def read(filters, names=None):
        counted.clear()
        reader = shapefile.PushingReader(options, schema if names is None else StructType([f for f in schema.fields if f.name in names]))
        left = list(reader.pushFilters(filters))
        rows = [r for part in reader.partitions() for r in reader.read(part)]
        return rows, left, sum(c.read for c in counted)

    everything, _, all_bytes = read([])
    some, left, few = read([GreaterThanOrEqual(("xmax",), 950.0), LessThanOrEqual(("xmin",), 1050.0)])
    assert len(everything) == 40 and len(some) == 1 and not left and few < all_bytes / 8
    one, left, fewer = read([EqualTo(("GEOID20",), "id7"), EqualTo(("shape",), 5)])
    assert [r[0] for r in one] == ["id7"] and len(left) == 1 and fewer < few
    assert len(read([], ["shape"])[0][0]) == 1


def test_pushed_filters_give_the_same_rows(spark, tmp_path):
    shapes = [*many(12, 20), None]
    write_shapefile(tmp_path / "a", shapes)
    with_boxes(tmp_path / "a", shapes)
    plain = shapefile.read_shapefile(spark, str(tmp_path), parts="3")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = shapefile.read_shapefile(spark, str(tmp_path), parts="3", push="true")
        for condition in ("xmin > 300 and xmax < 900", "GEOID20 = 'id3'", "GEOID20 in ('id1', 'id2', 'id99')", "GEOID20 like 'id1%'", "xmin is not null and shape = 5", "ymin < -1000", "geom is null", "xmin > 300 or GEOID20 = 'id0'"):
            names = lambda df: sorted(r.GEOID20 for r in df.filter(condition).collect())  # noqa: B023, E731
            assert names(pushed) == names(plain), condition
        narrow = shapefile.read_shapefile(spark, str(tmp_path), fields="", push="true")
        assert narrow.columns == ["shape", "geom", *pruning.BOX] and narrow.filter("xmin > 300").count() == 8
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_geopackage_there_and_back(spark, tmp_path):
    shapes = [(1, square(0.0, 0.0) + square(300.0, 0.0) + square(10.0, 10.0, 20.0)), (2, square(50.0, 500.0)), (3, None), (4, [])]
    rows = polygons(spark, shapes).withColumns({"name": F.concat(F.lit("é'\"_"), F.col("id").cast("string")), "share": F.col("id") / 2, "ok": F.col("id") > 2})
    path = str(tmp_path / "out")
    geopackage.write_geopackage(rows.repartition(3), path, "zones", 32618)
    got = {r.id: r for r in geopackage.read_geopackage(spark, path, parts="2").collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[3].geom is None and got[4].geom is None
    assert [len(r) for r in got[1].geom] == [4, 4, 4] and got[1].name == "é'\"_1" and got[2].share == 1.0 and got[1].ok == 0 and got[3].ok == 1
    # each part's holes follow its outer ring
    assert [(r[0].x, r[0].y) for r in got[1].geom] == [(0.0, 0.0), (10.0, 10.0), (300.0, 0.0)]
    assert (got[1].xmin, got[1].ymin, got[1].xmax, got[1].ymax) == (0.0, 0.0, 400.0, 100.0)
    areas = {r.id: r.a for r in geopackage.read_geopackage(spark, path).select("id", geometry.area(F.col("geom")).alias("a")).collect()}
    assert areas[1] == 20000 - 400 and areas[2] == 10000
    file = next((tmp_path / "out").glob("*.gpkg"))
    con = sqlite3.connect(file)
    assert con.execute("pragma application_id").fetchone()[0] == geopackage.APPLICATION_ID and con.execute("select table_name, srs_id from gpkg_geometry_columns").fetchall() == [("zones", 32618)]
    geopackage.write_geopackage(rows.filter("id = 2"), path, "zones", 32618, mode="append")
    assert geopackage.read_geopackage(spark, path).count() == 5
    geopackage.write_geopackage(rows.filter("id = 2"), path, "zones", 32618)
    assert geopackage.read_geopackage(spark, path).count() == 1 and len(list((tmp_path / "out").glob("*.gpkg"))) == 1


def test_a_failed_write_leaves_nothing_and_a_retried_task_one_copy(spark, tmp_path):
    rows = polygons(spark, [(i, square(100.0 * i, 0.0)) for i in range(8)])
    path = tmp_path / "out"
    geopackage.write_geopackage(rows, str(path))
    before = sorted(p.name for p in path.iterdir() if not p.name.startswith("."))
    bad = rows.repartition(4).withColumn("id", F.when(F.col("id") == 5, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        geopackage.write_geopackage(bad, str(path))
    assert geopackage.read_geopackage(spark, str(path)).count() == 8
    assert sorted(p.name for p in path.iterdir() if not p.name.startswith(".")) == before
    # a task that ran twice: only the file that its message names counts, and the other goes
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"id long, geom array<{geometry.POLYGON}>")
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]]]])], ["id", "geom"])
    writer = geopackage.GeoPackageWriter({"path": str(tmp_path / "twice")}, schema, True)
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.name != kept.name
    writer.commit([kept, None])
    assert [p.name for p in (tmp_path / "twice").glob("*.gpkg")] == [kept.name]
    assert geopackage.read_geopackage(spark, str(tmp_path / "twice")).count() == 1


def test_other_geometries_and_broken_files(spark, tmp_path):
    point = struct.pack("<BI2d", 1, 1, 3.0, 4.0)
    line = struct.pack(">BII4d", 0, 1002, 2, 0.0, 0.0, 9.0, 1.0)[:9] + struct.pack(">6d", 0.0, 0.0, 9.0, 1.0, 2.0, 9.0)
    both = struct.pack("<BII", 1, 7, 2) + point + line
    assert geopackage.rings_of(both) == [[(3.0, 4.0)], [(0.0, 0.0), (1.0, 2.0)]]
    with pytest.raises(ValueError):
        geopackage.rings_of(struct.pack("<BI", 1, 15))
    assert geopackage.parsed(b"GP\x00\x01\x00\x00\x00\x00" + point) == (None, point)
    geopackage.write_geopackage(polygons(spark, [(1, square(0.0, 0.0))]), str(tmp_path / "good"))
    good = next((tmp_path / "good").glob("*.gpkg")).read_bytes()
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.gpkg").write_bytes(b"not a database" * 100)
    (tmp_path / "mixed" / "b.gpkg").write_bytes(good)
    assert geopackage.read_geopackage(spark, str(tmp_path / "mixed"), skip="true").count() == 1
    with pytest.raises(Exception, match="(?s)."):
        geopackage.read_geopackage(spark, str(tmp_path / "mixed")).count()


def test_projections_there_and_back(spark):
    places = [(lon, lat) for lon in (-124.0, -96.0, -70.3, -77.0) for lat in (25.0, 38.5, 48.9)]
    for crs, shift in (("EPSG:5070", 0.0), ("EPSG:3338", -58.0), ("EPSG:32618", None), ("EPSG:26904", None)):
        middle = geometry.UTM.get(crs)
        rows = [(middle + (i % 7 - 3) * 0.99, lat) for i, (_, lat) in enumerate(places)] if middle else [(lon + shift, lat + (20 if shift else 0)) for lon, lat in places]
        df = spark.createDataFrame(rows, "lon double, lat double")
        x, y = geometry.projected(F.col("lon"), F.col("lat"), crs)
        df = df.select("lon", "lat", x.alias("x"), y.alias("y"))
        lon, lat = geometry.unprojected(F.col("x"), F.col("y"), crs)
        df = df.select("*", lon.alias("lon2"), lat.alias("lat2"))
        x, y = geometry.projected(F.col("lon2"), F.col("lat2"), crs)
        for r in df.select("*", x.alias("x2"), y.alias("y2")).collect():
            assert abs(r.x - r.x2) < 1e-3 and abs(r.y - r.y2) < 1e-3 and abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8
    shape = polygons(spark, [(1, [[(1_700_000.0, 1_900_000.0), (1_701_000.0, 1_900_000.0), (1_700_000.0, 1_901_000.0)]])])
    moved = shape.select(geometry.reprojected_polygon(F.col("geom"), "EPSG:5070", "EPSG:32618").alias("geom")).select(geometry.area(F.col("geom")).alias("a")).first()
    assert abs(moved.a - 500_000) / 500_000 < 0.02
