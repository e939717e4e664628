"""Readers and writers of the pipeline's files, on Spark's own formats where there are any."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planweave.functions import geometry, scalar
from planweave.session import qualified, removed, stored


def resolve_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first column, in the layer's order, whose upper-cased name is a candidate."""
    wanted = {c.upper() for c in candidates}
    return next((c for c in df.columns if c.upper() in wanted), None)


def with_geoid(df: DataFrame, candidates: tuple[str, ...] = ("GEOID20", "GEOID")) -> DataFrame:
    """GEOID20 by whichever name it has, and node_id, its 0-based rank."""
    found = resolve_column(df, list(candidates))
    if found is None:
        raise ValueError(f"none of {', '.join(candidates)} among {', '.join(df.columns)}")
    return with_row_ids(df.withColumnRenamed(found, "GEOID20"), "GEOID20", "node_id")


def with_row_ids(df: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """0-based ranks by `order` without one task for all: rows are ranged over partitions, and each partition's ranks begin after those before it.

    So what is to come in an order carries its place, whoever reads it.
    """
    order = [order] if isinstance(order, str) else order
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, nth).join(F.broadcast(before), "_part").withColumn(name, F.col(name) - 1 + F.col("_before")).drop("_part", "_before")


def _fields(line: Column) -> Column:
    return F.split(line, r"\|", -1)


def pl_geography(lines: DataFrame, line: str = "value") -> DataFrame:
    """logrecno, geoid of the tracts among pipe-separated geography lines."""
    f = _fields(F.col(line))
    kept = lines.select(f.alias("f")).filter((F.size("f") >= 10) & (F.trim(F.get("f", 2)) == "140"))
    return kept.select(scalar.zero_filled(F.get("f", 7), 7).alias("logrecno"), scalar.geoid_of(F.trim(F.get("f", 8))).alias("geoid"))


# 0-based positions of the counts in a segment-1 line.
PL_COUNTS = {"total": 76, "hispanic": 77, "nh_white": 80, "nh_black": 81, "nh_aian": 82, "nh_asian": 83, "nh_nhpi": 84, "nh_other": 85, "nh_two": 86}


def pl_counts(lines: DataFrame, line: str = "value") -> DataFrame:
    """logrecno and counts of pipe-separated segment lines; lines with a bad number go."""
    f = _fields(F.col(line))
    rows = lines.select(f.alias("f")).filter(F.size("f") >= 87)
    rows = rows.select(scalar.zero_filled(F.get("f", 4), 7).alias("logrecno"), *(F.trim(F.get("f", at)).try_cast("bigint").alias(n) for n, at in PL_COUNTS.items()))
    return rows.dropna().withColumn("nh_other", F.col("nh_other") + F.col("nh_two")).drop("nh_two")


def pl_tracts(geography: DataFrame, counts: DataFrame) -> DataFrame:
    return geography.join(counts, "logrecno")


def read_pl(spark: SparkSession, geography: str, segment: str) -> DataFrame:
    text = lambda path: spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").schema("value string").csv(path)
    return pl_tracts(pl_geography(text(geography)), pl_counts(text(segment)))


def wide_to_long(wide: DataFrame, prefix: str = "n", block: str | None = None, width: int = 0) -> DataFrame:
    """step, node_id, zone from one column per node: an array of the columns, exploded by position.

    With `block`, a step has several rows, each of `width` nodes from `block` * `width` on; columns without a node are null there and go.
    """
    named = [c for c in wide.columns if re.fullmatch(rf"{prefix}\d+", c)]
    ids = F.array(*(F.lit(int(c[len(prefix) :])).cast("bigint") for c in named))
    first = (F.col(block) * width).cast("bigint") if block else F.lit(0).cast("bigint")
    rows = wide.select("step", first.alias("first"), F.posexplode(F.array(*named)).alias("at", "zone"))
    rows = rows.filter("zone is not null") if block else rows
    return rows.select("step", (F.col("first") + F.get(ids, F.col("at"))).alias("node_id"), F.col("zone").cast("bigint").alias("zone"))


LEAN = "map<string, struct<districts: map<string, struct<harris_pct: double, lean: string, margin: int, label: string>>, D: int, R: int>>"


def flatten_lean(documents: DataFrame, column: str = "value") -> DataFrame:
    """state, zone, share, lean, margin, label from nested JSON; entries without districts (totals, bands) go."""
    states = documents.select(F.explode(F.from_json(column, LEAN)).alias("state", "x")).filter("x.districts is not null")
    return states.select("state", F.explode("x.districts").alias("zone", "d")).select("state", F.col("zone").cast("int").alias("zone"), F.col("d.harris_pct").alias("share"), "d.lean", "d.margin", "d.label")


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name (below `path`), bytes, sha256 of the files under `path`, each read as a stream, so a file may be of any size. Empty files, which Spark's scans leave out, have no row."""
    root = qualified(spark, path).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")

    def digested(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            found = []
            for name in frame["path"]:
                store, where = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                digest = hashlib.sha256()
                with store.open_input_stream(where, compression=None) as stream:
                    while piece := stream.read(1 << 20):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield frame.assign(sha256=found)

    tail = F.regexp_replace("path", r"^[a-z0-9]+:/+", "")
    base = re.sub(r"^[a-z0-9]+:/+", "", root)
    below = F.when(F.startswith(tail, F.lit(base + "/")), F.substring(tail, F.lit(len(base) + 2), F.length(tail))).otherwise(F.element_at(F.split("path", "/"), -1))
    return files.repartition(F.col("path")).mapInPandas(digested, "path string, length long, sha256 string").select(below.alias("name"), F.col("length").alias("bytes"), "sha256")


def _section() -> Column:
    return F.when(F.contains("name", F.lit("/")), F.substring_index("name", "/", 1)).otherwise("")


def archive_summary(files: DataFrame) -> DataFrame:
    """section (the first folder, empty for files at the top), files, bytes of each and, section null, of all."""
    return files.select(_section().alias("section"), "bytes").rollup("section").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


# ---- chunks under a manifest


def _versions(spark: SparkSession, path: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    names = [f.getPath().getName() for f in store.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[dict]]:
    """The last version, or one, and its entries: folder, chunk (null for several), first and last step."""
    versions = _versions(spark, path)
    if not versions:
        return 0, []
    version = versions[-1] if version is None else version
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/{version:08d}.json")
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return version, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, version: int, entries: list[dict]) -> None:
    """Make `entries` the table, in one step: a whole file gets the next version's name, unless another writer was faster."""
    jvm = spark._jvm
    draft, final = (jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/{n}") for n in (f".{uuid.uuid4().hex}", f"{version:08d}.json"))
    store = final.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = store.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(entries).encode()))
    finally:
        stream.close()
    if store.exists(final) or not store.rename(draft, final):
        store.delete(draft, False)
        raise RuntimeError(f"version {version} of {path} was written by another")


def write_chunk(plans: DataFrame, path: str, chunk: int) -> None:
    """One chunk of plans (step, ...), which takes the place of an earlier one of its number once it is written whole; readers see either."""
    spark, folder = plans.sparkSession, f"data/chunk-{chunk}-{uuid.uuid4().hex}"
    plans.write.parquet(f"{path}/{folder}")
    first, last, rows = spark.read.parquet(f"{path}/{folder}").agg(F.min("step"), F.max("step"), F.count(F.lit(1))).first()
    version, entries = _manifest(spark, path)
    if any(chunk in (e["chunks"] if len(e["chunks"]) > 1 else []) for e in entries):
        raise ValueError(f"chunk {chunk} is part of a compacted table")
    kept = [e for e in entries if e["chunks"] != [chunk]]
    _switch(spark, path, version + 1, sorted([*kept, {"folder": folder, "chunks": [chunk], "first": first, "last": last, "rows": rows}], key=lambda e: e["chunks"][0]))


def read_chunks(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as the last manifest, or that of a version, names it; what is written meanwhile isn't seen."""
    _, entries = _manifest(spark, path, version)
    if not entries:
        raise ValueError(f"no chunks under {path}")
    return spark.read.parquet(*(f"{path}/{e['folder']}" for e in entries))


def consolidate(spark: SparkSession, path: str, keep: int = 1) -> DataFrame:
    """All chunks as one table ordered by step, in place.

    The manifest is switched when it is there; only then do folders go that neither it nor
    the `keep` versions before it name, so a reader that began before the switch still finds
    its own. A run that fails leaves the table as it was.
    """
    version, entries = _manifest(spark, path)
    folder = f"data/all-{uuid.uuid4().hex}"
    read_chunks(spark, path).repartitionByRange("step").sortWithinPartitions("step").write.parquet(f"{path}/{folder}")
    rows = spark.read.parquet(f"{path}/{folder}").count()
    if rows != sum(e["rows"] for e in entries):
        raise RuntimeError(f"{rows} rows of {sum(e['rows'] for e in entries)}")
    steps = [(e["first"], e["last"]) for e in entries if e["rows"]]
    _switch(spark, path, version + 1, [{"folder": folder, "chunks": sorted(c for e in entries for c in e["chunks"]), "first": min((a for a, _ in steps), default=None), "last": max((b for _, b in steps), default=None), "rows": rows}])
    vacuum(spark, path, keep)
    return read_chunks(spark, path)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete what neither the last manifest nor the `keep` before it name."""
    versions = _versions(spark, path)
    old, held = versions[: -1 - keep], versions[-1 - keep :]
    named = {e["folder"] for v in held for e in _manifest(spark, path, v)[1]}
    for v in old:
        for e in _manifest(spark, path, v)[1]:
            if e["folder"] not in named:
                removed(spark, f"{path}/{e['folder']}")
        removed(spark, f"{path}/_manifest/{v:08d}.json")


def resume_at(spark: SparkSession, path: str) -> int:
    """The step after the last that was written, which the manifest knows; 0 if none was."""
    return max((e["last"] + 1 for e in _manifest(spark, path)[1] if e["last"] is not None), default=0)


# ---- archives


def archived(spark: SparkSession, source: str, target: str, pattern: str = "*") -> DataFrame:
    """name, bytes, sha256, copied: the files under `source` as they are under `target`, after those that weren't there were copied.

    Files are shared out to the tasks by name. One that is there with the same content is left
    alone; any other is copied under a name of its own, read again, and only moved to its
    place if its checksum is the source's: what breaks off leaves nothing half-written.
    """
    found, into = checksums(spark, source, pattern), qualified(spark, target).rstrip("/")
    base = qualified(spark, source).rstrip("/")

    def copied(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        origin, start = fs.FileSystem.from_uri(base)
        store, end = fs.FileSystem.from_uri(into)

        def digest(where: str) -> str | None:
            if store.get_file_info(where).type != fs.FileType.File:
                return None
            total = hashlib.sha256()
            with store.open_input_stream(where, compression=None) as stream:
                while piece := stream.read(1 << 20):
                    total.update(piece)
            return total.hexdigest()

        for frame in frames:
            marks = []
            for name, told in zip(frame["name"], frame["sha256"], strict=True):
                where = f"{end}/{name}"
                if digest(where) == told:
                    marks.append(False)
                    continue
                store.create_dir(where.rpartition("/")[0])
                draft = f"{where}.{uuid.uuid4().hex}.part"
                with origin.open_input_stream(f"{start}/{name}", compression=None) as stream, store.open_output_stream(draft, compression=None) as out:
                    while piece := stream.read(1 << 20):
                        out.write(piece)
                if digest(draft) != told:
                    store.delete_file(draft)
                    raise OSError(f"{name} was not copied as it is")
                store.move(draft, where)
                marks.append(True)
            yield frame.assign(copied=marks)

    schema = "name string, bytes long, sha256 string, copied boolean"
    return stored(found.mapInPandas(copied, schema), "archive")


def write_manifest(files: DataFrame, path: str) -> None:
    """Size and checksum of every file, by section and name, as lines of JSON."""
    files.withColumn("section", _section()).select("section", "name", "bytes", "sha256").repartitionByRange("section", "name").sortWithinPartitions("section", "name").write.mode("overwrite").json(path)


def first_readable(spark: SparkSession, sources: list[tuple[str, str]], **options) -> DataFrame:
    """The first of the (format, path) sources that can be read: a better source may be missing."""
    problem = None
    for kind, path in sources:
        try:
            return spark.read.format(kind).options(**options).load(path)
        except (AnalysisException, ValueError, OSError, PythonException) as e:
            problem = e
    raise ValueError(f"none of {', '.join(p for _, p in sources)} can be read") from problem


def county_codes(counties: DataFrame, state: str) -> DataFrame:
    """geoid of a state's counties: as it is, or else state and county code together."""
    geoid = F.coalesce(F.nullif(F.trim("geoid"), F.lit("")), F.concat("statefp", "countyfp"))
    return counties.filter(F.col("statefp") == state).select(geoid.alias("geoid")).filter("geoid is not null").distinct()


def write_geometry(rows: DataFrame, path: str, geom: str = "geom") -> None:
    """Parquet with the polygons as well-known text, which other tools read; `geopackage.write_geopackage` writes the binary format."""
    rows.withColumn(geom, geometry.well_known_text(F.col(geom))).write.mode("overwrite").parquet(path)


def picked(rows: DataFrame, wanted: list[int], key: str = "step") -> DataFrame:
    """The rows of the wanted keys with `place`, the position of their key in the list: ordered by it they come as asked for."""
    spots = rows.sparkSession.createDataFrame(list(enumerate(wanted)), f"place int, {key} {rows.schema[key].dataType.simpleString()}")
    return rows.join(F.broadcast(spots), key)


def stamped(rows: DataFrame, name: str = "written_at") -> DataFrame:
    """The time of the query, in ISO form and UTC."""
    return rows.withColumn(name, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
