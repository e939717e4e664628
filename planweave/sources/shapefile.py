"""A Spark data source for ESRI shapefiles: `spark.dataSource.register(Shapefile)`, then `spark.read.format("shapefile").load(path)`.

A path names one .shp or a folder of them (the first by name with option `first`).
Each file is read in as many partitions as option `parts` says, by the record places
in its .shx index. Rows have the attributes as strings, `geom` (rings of points; null
for null shapes) and `shape` (the shape type). Unreadable files are skipped with
option `skip`.
"""

from __future__ import annotations

import logging
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import StructType

from planweave.session import qualified
from planweave.sources.pruning import BOX, BOX_COLUMNS, Wanted

GEOMETRY = f"shape int, geom array<array<struct<x:double,y:double>>>, {BOX_COLUMNS}"
#: Bytes of a record's type, box and counts, and records between which less than GAP bytes lie are read at once, up to CHUNK bytes.
HEAD, GAP, CHUNK = 44, 4096, 8 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _files(path: str, pattern: str = "") -> tuple[object, list[str]]:
    from pyarrow import fs

    store, where = _store(path)
    if where.endswith(".shp"):
        return store, [where]
    found = store.get_file_info(fs.FileSelector(where, recursive=True))
    return store, sorted(f.path for f in found if f.path.endswith(".shp") and pattern in f.path)


def _attributes(store, base: str) -> tuple[int, int, int, list[tuple[str, int]]]:
    """Of a .dbf: rows, header bytes, row bytes, fields with widths."""
    with store.open_input_file(base + ".dbf") as f:
        head = f.read(32)
        rows, header, width = struct.unpack("<IHH", head[4:12])
        raw, fields = f.read(header - 32), []
        for at in range(0, len(raw) - 31, 32):
            if raw[at] == 13:
                break
            fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), raw[at + 16]))
    return rows, header, width, fields


def shape(content: bytes) -> tuple[int, list[list[tuple[float, float]]] | None]:
    """Type and rings of a record: points are one ring of one point."""
    (kind,) = struct.unpack("<i", content[:4])
    plain = kind % 10
    if plain == 0:
        return kind, None
    if plain == 1:
        return kind, [[struct.unpack("<2d", content[4:20])]]
    if plain == 8:
        (n,) = struct.unpack("<i", content[36:40])
        starts, first = [0], 40
    elif plain in (3, 5):
        parts, n = struct.unpack("<2i", content[36:44])
        starts, first = list(struct.unpack(f"<{parts}i", content[44 : 44 + 4 * parts])), 44 + 4 * parts
    else:
        raise ValueError(f"shape type {kind}")
    flat = struct.unpack(f"<{2 * n}d", content[first : first + 16 * n])
    points = list(zip(flat[::2], flat[1::2], strict=True))
    return kind, [points[a:b] for a, b in zip(starts, [*starts[1:], n], strict=True)]


def box_of(head: bytes) -> tuple[float, float, float, float] | None:
    """A record's box, by its first bytes."""
    (kind,) = struct.unpack("<i", head[:4])
    if kind % 10 == 0:
        return None
    if kind % 10 == 1:
        x, y = struct.unpack("<2d", head[4:20])
        return x, y, x, y
    return struct.unpack("<4d", head[4:36])


class Part(InputPartition):
    def __init__(self, base: str, low: int, high: int):
        super().__init__((base, low, high))


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns, self.wanted = options, schema.names, Wanted()

    def partitions(self) -> list[Part]:
        store, files = _files(self.options["path"], self.options.get("pattern", ""))
        files, parts, out = files[:1] if self.options.get("first") == "true" else files, int(self.options.get("parts", 8)), []
        for name in files:
            try:
                rows = (store.get_file_info(name[:-4] + ".shx").size - 100) // 8
            except (OSError, TypeError):
                if self.options.get("skip") == "true":
                    continue
                raise
            size = max(1, -(-rows // parts))
            out += [Part(name[:-4], a, min(rows, a + size)) for a in range(0, rows, size)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        base, low, high = partition.value
        store, _ = _store(self.options["path"])
        rows = self._rows(store, base, low, high)
        if self.options.get("skip") != "true":
            yield from rows
            return
        try:
            found = list(rows)  # a part that breaks off is left out whole
        except (OSError, struct.error, ValueError) as e:
            logging.getLogger(__name__).warning("%s.shp, records %d to %d: %s", base, low, high, e)
            return
        yield from found

    def _rows(self, store, base: str, low: int, high: int) -> Iterator[tuple]:
        with store.open_input_file(base + ".shx") as f:
            places = struct.unpack(f">{2 * (high - low)}i", f.read_at(8 * (high - low), 100 + 8 * low))
        _, header, width, fields = _attributes(store, base)
        spans, at = {}, 1
        for name, size in fields:
            spans[name], at = (at, at + size), at + size
        with store.open_input_file(base + ".dbf") as f:
            table = f.read_at(width * (high - low), header + width * low)
        text = lambda i, name: table[i * width + spans[name][0] : i * width + spans[name][1]].decode("latin-1").strip() or None
        tried = [n for n in spans if n in self.wanted.names()]
        kept = [i for i in range(high - low) if self.wanted.row({n: text(i, n) for n in tried})]
        with store.open_input_file(base + ".shp") as f:
            if self.wanted.box:
                kept = [i for i in kept if self.wanted.inside(box_of(f.read_at(min(HEAD, 2 * places[2 * i + 1]), 2 * places[2 * i] + 8)))]
            shapes = self._contents(f, [(2 * places[2 * i] + 8, 2 * places[2 * i + 1]) for i in kept])
            decoded = [n for n in spans if n in self.columns]
            for i, content in zip(kept, shapes, strict=True):
                row = {n: text(i, n) for n in decoded}
                row["shape"], row["geom"] = shape(content)
                row.update(zip(BOX, box_of(content) or (None,) * 4, strict=True))
                yield tuple(row.get(c) for c in self.columns)

    @staticmethod
    def _contents(f, places: list[tuple[int, int]]) -> Iterator[bytes]:
        """The records at (offset, length), those that lie close together read at once."""
        at = 0
        while at < len(places):
            start, end, last = places[at][0], sum(places[at]), at + 1
            while last < len(places) and 0 <= places[last][0] - end <= GAP and sum(places[last]) - start <= CHUNK:
                end, last = sum(places[last]), last + 1
            held = f.read_at(end - start, start)
            yield from (held[a - start : a - start + n] for a, n in places[at:last])
            at = last


class PushingReader(ShapefileReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return self.wanted.take(filters, set(self.columns) - {"shape", "geom", *BOX})


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        store, files = _files(self.options["path"], self.options.get("pattern", ""))
        if not files:
            raise ValueError(f"no .shp under {self.options['path']}")
        names = [n for n, _ in _attributes(store, files[0][:-4])[3]]
        asked = self.options.get("fields")
        if asked is not None:
            names = [n for n in names if n in asked.split(",")]
        return ", ".join([*(f"`{n}` string" for n in names), GEOMETRY])

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("push") == "true" else ShapefileReader)(dict(self.options), schema)


def read_shapefile(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """`path` may be on Spark's default file system: the source's tasks get it whole."""
    spark.dataSource.register(Shapefile)
    return spark.read.format("shapefile").options(**options).load(qualified(spark, path))
