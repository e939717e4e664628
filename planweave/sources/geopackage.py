"""GeoPackages as a Spark data source, to read and to write: `spark.dataSource.register(GeoPackage)`, format "geopackage".

A GeoPackage is an SQLite file of tables with a geometry column. Reading: a path names one
.gpkg or a folder of them; a folder that was written here is read by its manifest. Each file
is read in as many partitions as option `parts` says, by ranges of row ids. Rows have the
layer's columns, `geom` (rings of points, parts one after the other) and their box. Options `layer`,
`fields`, `push` and `skip` are as for shapefiles.

Writing: every task makes a file of its own in the job's folder, which the driver has made; its
commit moves those that the tasks' messages name beside the others, puts their names into the
manifest, in one step, and removes the job's folder with what a task that failed or ran twice
has left. After an abort that folder is gone, so a late task can't leave anything either.
"""

from __future__ import annotations

import json
import logging
import sqlite3
import struct
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from planweave.functions import geometry
from planweave.session import qualified
from planweave.sources.pruning import BOX, BOX_COLUMNS, Wanted

MANIFEST = "_manifest.json"
# Fixed values of the format: its marks in the file's header, types of columns, and lengths of envelopes by their code.
APPLICATION_ID, USER_VERSION = 0x47504B47, 10300
TYPES = {"INTEGER": "long", "INT": "long", "MEDIUMINT": "long", "SMALLINT": "long", "TINYINT": "long", "BOOLEAN": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary"}
ENVELOPES = (0, 32, 48, 48, 64)
WRITTEN = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL", "binary": "BLOB"}


# ---- geometries


def rings_of(wkb: bytes) -> list[list[tuple[float, float]]]:
    """The rings of a well-known binary geometry, parts one after the other; points and lines are rings of their points."""
    out: list[list[tuple[float, float]]] = []

    def ring(at: int, order: str, width: int) -> int:
        (n,) = struct.unpack_from(order + "I", wkb, at)
        flat = struct.unpack_from(f"{order}{n * width}d", wkb, at + 4)
        out.append(list(zip(flat[::width], flat[1::width], strict=True)))
        return at + 4 + 8 * n * width

    def one(at: int) -> int:
        order = "<" if wkb[at] else ">"
        (kind,) = struct.unpack_from(order + "I", wkb, at + 1)
        width = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
        kind, at = kind % 1000, at + 5
        if kind == 1:
            point = struct.unpack_from(order + "2d", wkb, at)
            out.append([point])
            return at + 8 * width
        if kind == 2:
            return ring(at, order, width)
        if kind not in (3, 4, 5, 6, 7):
            raise ValueError(f"geometry type {kind}")
        (n,) = struct.unpack_from(order + "I", wkb, at)
        at += 4
        for _ in range(n):
            at = ring(at, order, width) if kind == 3 else one(at)
        return at

    one(0)
    return out


def opened_ring(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def wkb_of(parts: list[list[list[dict[str, float]]]]) -> bytes:
    """A MultiPolygon of parts, each an outer ring and its holes; rings are closed."""
    out = [struct.pack("<BII", 1, 6, len(parts))]
    for rings in parts:
        out.append(struct.pack("<BII", 1, 3, len(rings)))
        for ring in rings:
            flat = [v for p in ring for v in (p["x"], p["y"])]
            if flat[:2] != flat[-2:] or len(ring) == 1:
                flat += flat[:2]
            out.append(struct.pack(f"<I{len(flat)}d", len(flat) // 2, *flat))
    return b"".join(out)


def blob_of(parts: list | None, srs: int) -> bytes | None:
    """A geometry as the format stores it, with its box in front."""
    if parts is None:
        return None
    points = [p for rings in parts for ring in rings for p in ring]
    if not points:
        return b"GP" + struct.pack("<BBi", 0, 0b00010001, srs) + wkb_of([])
    xs, ys = [p["x"] for p in points], [p["y"] for p in points]
    return b"GP" + struct.pack("<BBi4d", 0, 0b00000011, srs, min(xs), max(xs), min(ys), max(ys)) + wkb_of(parts)


def parsed(blob: bytes | None) -> tuple[tuple[float, ...] | None, bytes | None]:
    """Box (if it is there) and well-known binary of a stored geometry; null for none and for an empty one."""
    if blob is None:
        return None, None
    if blob[:2] != b"GP":
        raise ValueError("not a stored geometry")
    flags = blob[3]
    order, code = "<" if flags & 1 else ">", flags >> 1 & 7
    if flags >> 4 & 1:
        return None, None
    box = None
    if code:
        x0, x1, y0, y1 = struct.unpack_from(order + "4d", blob, 8)
        box = x0, y0, x1, y1
    return box, blob[8 + ENVELOPES[code] :]


# ---- files


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _files(path: str) -> tuple[object, list[str]]:
    from pyarrow import fs

    store, where = _store(path)
    where = where.rstrip("/")
    if where.endswith(".gpkg"):
        return store, [where]
    named = _manifest(store, where)
    if named is not None:
        return store, [f"{where}/{f}" for f in named]
    found = store.get_file_info(fs.FileSelector(where, recursive=True))
    return store, sorted(f.path for f in found if f.path.endswith(".gpkg") and "/_job-" not in f.path)


def _manifest(store, where: str) -> list[str] | None:
    from pyarrow import fs

    if store.get_file_info(f"{where}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{where}/{MANIFEST}") as f:
        return [x["name"] for x in json.loads(f.read())["files"]]


@contextmanager
def _database(store, name: str) -> Iterator[sqlite3.Connection]:
    """A file of this machine as it is; any other in a copy that goes with the task."""
    if store.type_name == "local":
        con = sqlite3.connect(f"file:{name}?mode=ro&immutable=1", uri=True)
        try:
            yield con
        finally:
            con.close()
        return
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as copy:
        with store.open_input_stream(name) as f:
            while piece := f.read(8 << 20):
                copy.write(piece)
        copy.flush()
        con = sqlite3.connect(f"file:{copy.name}?mode=ro&immutable=1", uri=True)
        try:
            yield con
        finally:
            con.close()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _layer(con: sqlite3.Connection, asked: str | None) -> tuple[str, str, list[tuple[str, str]]]:
    """Table, geometry column, and the other columns with their types."""
    layers = con.execute("select table_name, column_name from gpkg_geometry_columns order by table_name").fetchall()
    found = [x for x in layers if asked in (None, x[0])]
    if not found:
        raise ValueError(f"no layer {asked or ''}")
    table, geom = found[0]
    columns = [(r[1], TYPES.get(r[2].upper().split("(")[0], "string")) for r in con.execute(f"pragma table_info({_quoted(table)})") if r[1] != geom]
    return table, geom, columns


class Rows(InputPartition):
    def __init__(self, name: str, low: int, high: int):
        super().__init__((name, low, high))


class GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns, self.wanted = options, schema.names, Wanted()
        self.kinds = {f.name: f.dataType.simpleString() for f in schema.fields}

    def partitions(self) -> list[Rows]:
        store, files = _files(self.options["path"])
        parts, out = int(self.options.get("parts", 8)), []
        for name in files:
            try:
                with _database(store, name) as con:
                    table, _, _ = _layer(con, self.options.get("layer"))
                    low, high = con.execute(f"select min(rowid), max(rowid) from {_quoted(table)}").fetchone()
            except (sqlite3.Error, OSError, ValueError):
                if self.options.get("skip") == "true":
                    continue
                raise
            if low is not None:
                size = max(1, -(-(high + 1 - low) // parts))
                out += [Rows(name, a, min(high + 1, a + size)) for a in range(low, high + 1, size)]
        return out

    def read(self, partition: Rows) -> Iterator[tuple]:
        name, low, high = partition.value
        store, _ = _store(self.options["path"])
        try:
            with _database(store, name) as con:
                rows = self._rows(con, low, high)
                if self.options.get("skip") == "true":
                    rows = list(rows)
                yield from rows
        except (sqlite3.Error, OSError, ValueError, struct.error) as e:
            if self.options.get("skip") != "true":
                raise
            logging.getLogger(__name__).warning("%s, rows %d to %d: %s", name, low, high, e)

    def _rows(self, con: sqlite3.Connection, low: int, high: int) -> Iterator[tuple]:
        table, geom, columns = _layer(con, self.options.get("layer"))
        there = [n for n, _ in columns if n in self.columns]
        asked = ", ".join(map(_quoted, [geom, *there]))
        for blob, *values in con.execute(f"select {asked} from {_quoted(table)} where rowid >= ? and rowid < ?", (low, high)):
            row = {n: v if v is None else bool(v) if self.kinds[n] == "boolean" else v for n, v in zip(there, values, strict=True)}
            if not self.wanted.row({n: row.get(n) for n in self.wanted.names()}):
                continue
            box, wkb = parsed(blob)
            rings = None
            if wkb is not None and box is None:  # no box is stored: it is the points'
                rings = [opened_ring(r) for r in rings_of(wkb)]
                xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
                box = (min(xs), min(ys), max(xs), max(ys)) if xs else None
            if not self.wanted.inside(box):
                continue
            row["geom"] = rings if rings is not None or wkb is None else [opened_ring(r) for r in rings_of(wkb)]
            row.update(zip(BOX, box or (None,) * 4, strict=True))
            yield tuple(row.get(c) for c in self.columns)


class PushingReader(GeoPackageReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return self.wanted.take(filters, {n for n, kind in self.kinds.items() if kind == "string"})


class Written(WriterCommitMessage):
    def __init__(self, name: str, rows: int):
        self.name, self.rows = name, rows


class GeoPackageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex[:12]
        self.layer, self.srs = options.get("layer", "layer"), int(options.get("srs", 0))
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        if "geom" not in schema.names:
            raise ValueError("no column geom")
        store, where = _store(self.path)
        store.create_dir(f"{where}/_job-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        con, rows = sqlite3.connect(":memory:"), 0
        self._create(con)
        marks = ", ".join("?" * len(self.fields))
        for batch in iterator:
            columns = [[blob_of(g, self.srs) for g in c.to_pylist()] if n == "geom" else c.to_pylist() for (n, _), c in zip(self.fields, batch.columns, strict=True)]
            con.executemany(f"insert into {_quoted(self.layer)} ({', '.join(_quoted(n) for n, _ in self.fields)}) values ({marks})", zip(*columns, strict=True))
            rows += batch.num_rows
        if not rows:
            return Written("", 0)
        con.commit()
        store, where = _store(self.path)
        name = f"part-{self.job}-{uuid.uuid4().hex[:12]}.gpkg"
        with store.open_output_stream(f"{where}/_job-{self.job}/{name}") as f:
            f.write(con.serialize())
        con.close()
        return Written(name, rows)

    def _create(self, con: sqlite3.Connection) -> None:
        con.execute(f"pragma application_id = {APPLICATION_ID}")
        con.execute(f"pragma user_version = {USER_VERSION}")
        con.executescript("""
          create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
          create table gpkg_contents (table_name text primary key, data_type text not null, identifier text, description text, last_change text, min_x double, min_y double, max_x double, max_y double, srs_id integer);
          create table gpkg_geometry_columns (table_name text primary key, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null);""")
        for name, i, whose in (("Undefined Cartesian", -1, "NONE"), ("Undefined geographic", 0, "NONE"), ("WGS 84", 4326, "EPSG"), (f"EPSG {self.srs}", self.srs, "EPSG")):
            con.execute("insert or ignore into gpkg_spatial_ref_sys values (?, ?, ?, ?, 'undefined', null)", (name, i, whose, i))
        con.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (self.layer, self.layer, self.srs))
        con.execute("insert into gpkg_geometry_columns values (?, 'geom', 'MULTIPOLYGON', ?, 0, 0)", (self.layer, self.srs))
        others = "".join(f", {_quoted(n)} {WRITTEN.get(kind, 'TEXT')}" for n, kind in self.fields if n != "geom")
        taken = {n for n, _ in self.fields}
        key = next(k for k in ("fid", "ogc_fid", "_fid") if k not in taken)
        con.execute(f"create table {_quoted(self.layer)} ({key} integer primary key autoincrement, geom multipolygon{others})")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, where = _store(self.path)
        before = _manifest(store, where) or []
        written = [m for m in messages if m is not None and m.rows]
        for m in written:
            store.move(f"{where}/_job-{self.job}/{m.name}", f"{where}/{m.name}")
        files = [{"name": n, "rows": None} for n in before] if not self.overwrite else []
        files += [{"name": m.name, "rows": m.rows} for m in written]
        draft = f"{where}/_job-{self.job}/{MANIFEST}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"layer": self.layer, "files": files}).encode())
        store.move(draft, f"{where}/{MANIFEST}")
        if self.overwrite:
            for name in before:
                store.delete_file(f"{where}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, where = _store(self.path)
        for attempt in range(5):  # a task that is still writing may add a file meanwhile
            try:
                store.delete_dir(f"{where}/_job-{self.job}")
                return
            except FileNotFoundError:
                return
            except OSError:
                if attempt == 4:
                    raise
                time.sleep(0.2)


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        store, files = _files(self.options["path"])
        for name in files:
            try:
                with _database(store, name) as con:
                    columns = _layer(con, self.options.get("layer"))[2]
                break
            except (sqlite3.Error, OSError, ValueError):
                if self.options.get("skip") != "true":
                    raise
        else:
            raise ValueError(f"no readable .gpkg under {self.options['path']}")
        asked = self.options.get("fields")
        columns = [c for c in columns if asked is None or c[0] in asked.split(",")]
        return ", ".join([*(f"`{n}` {kind}" for n, kind in columns), f"geom {geometry.POLYGON}", BOX_COLUMNS])

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("push") == "true" else GeoPackageReader)(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> GeoPackageWriter:
        return GeoPackageWriter(dict(self.options), schema, overwrite)


def write_geopackage(rows: DataFrame, path: str, layer: str = "layer", srs: int = 0, mode: str = "overwrite") -> None:
    """`rows` with polygons in `geom`, each part's holes after its outer ring, into a folder of GeoPackages."""
    spark = rows.sparkSession
    spark.dataSource.register(GeoPackage)
    out = rows.withColumn("geom", geometry.nested(F.col("geom")))
    out.write.format("geopackage").mode(mode).option("layer", layer).option("srs", srs).save(qualified(spark, path))


def read_geopackage(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(GeoPackage)
    return spark.read.format("geopackage").options(**options).load(qualified(spark, path))
