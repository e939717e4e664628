"""A manifest of a dataset: Merkle trees over groups of rows, a proof for every row, and their check.

The leaves of a group are in order; every `arity` consecutive nodes of a level (the last run:
what is left, even one) become their digest, until one remains. Rows are ranged over parts in
the order of the trees, and a part turns its leaves into a sparse forest: the nodes, keyed by
group, level and index, whose siblings are elsewhere. Forests merge associatively: two make the
one of both, in which a run of siblings, whose number is known from the group's size, becomes its
parent as soon as all are there, again and again. The merge goes as a tree reduce, FAN forests
in a task a round, and what of a forest is resolved leaves it, so a forest has at most
twice the tree's height of nodes for the group it begins in and the one it ends in, and nothing passes
one task or the driver. The steps from each merged node up to what is left of its forest
are kept in a table a round; joined from the last round down, they are the upper part of
every row's proof, and the part's own tree is the lower.

Null groups are a group, nulls come first, and ids that are equal, or null, go by their leaves;
equal rows are leaves of their own. An empty table has no rows and no root. Columns other than
those named don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from planweave.session import stored

#: Leaves of a part at most, about, and forests that meet in a task.
LEAVES, FAN = 16_384, 128
STEPS = "array<struct<before:string,after:string>>"
NODE = "part long, gid long, size long, level long, index long, digest string, whole boolean"
MET = f"part long, gid long, size long, level long, index long, top_level long, top_index long, digest string, whole boolean, steps {STEPS}"
_STEP = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(*parts: str | Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: str | Column) -> Column:
    """What a leaf holds of a column: `-` for null, else how many bytes of UTF-8, a colon and the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: str | Column) -> Column:
    return digest(*map(field, values))


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]).cast("binary"), 256))


def proof(steps: Column) -> Column:
    """Digest of all siblings on the way up, each level's from left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def levels(n: int, arity: int) -> list[int]:
    """How many nodes each level of a tree of `n` leaves has."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def merged(nodes: dict[tuple[int, int], str], sizes: list[int], arity: int) -> tuple[dict[tuple[int, int], str], dict[tuple[int, int], tuple[str, str]]]:
    """A group's forest from the nodes of several, keyed by (level, index), and for every node that a parent was made for, the digests before and after it.

    The order in which forests are merged doesn't matter: a parent is made when all of its run is there.
    """
    open_nodes, steps = dict(nodes), {}
    for level in range(len(sizes) - 1):
        runs: dict[int, list[tuple[int, int]]] = {}
        for key in open_nodes:
            if key[0] == level:
                runs.setdefault(key[1] // arity, []).append(key)
        for parent, run in runs.items():
            if len(run) == min(arity, sizes[level] - parent * arity):
                run.sort()
                held = [open_nodes.pop(key) for key in run]
                for i, key in enumerate(run):
                    steps[key] = "".join(held[:i]), "".join(held[i + 1 :])
                open_nodes[level + 1, parent] = hashlib.sha256("".join(held).encode()).hexdigest()
    return open_nodes, steps


def way_up(key: tuple[int, int], steps: dict[tuple[int, int], tuple[str, str]], arity: int) -> tuple[list[tuple[str, str]], tuple[int, int]]:
    """From a node up to the one that is left of its forest: the steps, and that node's key."""
    out = []
    while key in steps:
        out.append(steps[key])
        key = key[0] + 1, key[1] // arity
    return out, key


def _groups(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each group's id, size, and the places of its rows."""
    gids, sizes = table["gid"].to_numpy(), table["size"].to_numpy()
    for gid in np.unique(gids):
        places = np.flatnonzero(gids == gid)
        yield int(gid), int(sizes[places[0]]), places


def _steps_array(ways: list[list[tuple[str, str]]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ways)]).astype(np.int32)
    before, after = [s[0] for w in ways for s in w], [s[1] for w in ways for s in w]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"]))


def _begun(table: pa.Table, arity: int) -> pa.Table:
    """The sparse forest of a part's leaves."""
    part, out = table["part"][0].as_py(), []
    index, leaf = table["index"].to_numpy(), table["leaf"].to_pylist()
    for gid, size, places in _groups(table):
        sizes = levels(size, arity)
        left, _ = merged({(0, int(index[i])): leaf[i] for i in places}, sizes, arity)
        out += [(part, gid, size, *key, d, key[0] == len(sizes) - 1) for key, d in left.items()]
    names = ["part", "gid", "size", "level", "index", "digest", "whole"]
    return pa.table({n: pa.array(c, pa.string() if n == "digest" else pa.bool_() if n == "whole" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)})


def _met(table: pa.Table, arity: int) -> pa.Table:
    """The forest of several: a row for each of their nodes, with the node that is left above it and the steps up to that."""
    part, out, ways = table["meet"][0].as_py(), [], []
    keys, digests = list(zip(table["level"].to_pylist(), table["index"].to_pylist(), strict=True)), table["digest"].to_pylist()
    for gid, size, places in _groups(table):
        sizes = levels(size, arity)
        left, steps = merged({keys[i]: digests[i] for i in places}, sizes, arity)
        for i in places:
            way, top = way_up(keys[i], steps, arity)
            out.append((part, gid, size, *keys[i], *top, left[top], top[0] == len(sizes) - 1))
            ways.append(way)
    names = ["part", "gid", "size", "level", "index", "top_level", "top_index", "digest", "whole"]
    columns = {n: pa.array(c, pa.string() if n == "digest" else pa.bool_() if n == "whole" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)}
    return pa.table(columns | {"steps": _steps_array(ways)})


def _proved(leaves: pa.Table, tops: pa.Table, arity: int, schema: pa.Schema) -> pa.Table:
    """A part's leaves, each with its own tree's steps and those from there to the root."""
    if not leaves.num_rows:
        return schema.empty_table()
    above = {(g, a, b): ([(s["before"], s["after"]) for s in steps], root) for g, a, b, steps, root in zip(*(tops[c].to_pylist() for c in ("gid", "level", "index", "steps", "root")), strict=True)}
    index, leaf = leaves["index"].to_numpy(), leaves["leaf"].to_pylist()
    ways, roots = [[]] * len(leaf), [""] * len(leaf)
    for gid, size, places in _groups(leaves):
        _, steps = merged({(0, int(index[i])): leaf[i] for i in places}, levels(size, arity), arity)
        for i in places:
            way, top = way_up((0, int(index[i])), steps, arity)
            more, roots[i] = above[gid, *top]
            ways[i] = way + more
    return pa.table({"row": leaves["row"], "leaf": leaves["leaf"], "root": pa.array(roots, pa.string()), "steps": _steps_array(ways)}).cast(schema)


def forest(rows: DataFrame, group: str, order: list[str], arity: int = 2, part: int = LEAVES, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """`rows` (group, the columns of `order`, leaf, and others) with `root` of the group's tree and `steps`, the leaf's proof in it; and the roots (group, root).

    Leaves stand in the order of `order`, then of their digests. `rows` is read several
    times, so it should be a stored table.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    names = [c for c in rows.columns if c != "leaf"]
    keys = [f"row.{c}" for c in (group, *order)] + ["leaf", "_tie"]
    flat = rows.select(F.struct(*names).alias("row"), "leaf", F.monotonically_increasing_id().alias("_tie"))
    count = flat.count()
    wanted = max(-(-count // part), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if count > part else 1
    ranged = flat.repartitionByRange(wanted, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    leaves = stored(ranged.select(F.spark_partition_id().cast("long").alias("part"), place.alias("at"), "row", "leaf"), "leaves")
    runs = leaves.groupBy("part", F.col(f"row.{group}").alias("group")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    ids = stored(runs.groupBy("group").agg(F.sum("n").alias("size")).withColumn("gid", F.monotonically_increasing_id()), "groups")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("gid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumnRenamed("group", "_group").join(ids, F.col("_group").eqNullSafe(F.col("group"))).select("part", "group", "gid", "size", (before - F.col("first")).alias("shift"))
    runs = stored(runs.withColumnRenamed("part", "_part"), "runs")
    held = leaves.join(runs, (F.col("part") == F.col("_part")) & F.col(f"row.{group}").eqNullSafe(F.col("group")))
    held = held.select("part", "gid", "size", (F.col("at") + F.col("shift")).alias("index"), "leaf", "row")

    begun = stored(held.drop("row").groupBy("part").applyInArrow(lambda t: _begun(t, arity), NODE), "forest")
    rounds, now = [], begun
    while True:
        still = now.filter("not whole").select(F.expr(f"part div {fan}").alias("meet"), "gid", "size", "level", "index", "digest")
        if still.isEmpty():
            break
        met = stored(still.groupBy("meet").applyInArrow(lambda t: _met(t, arity), MET), "merged")
        rounds.append(met)
        now = met.select("part", "gid", "size", F.col("top_level").alias("level"), F.col("top_index").alias("index"), "digest", "whole").distinct()
    # from the last round down: the steps of each round's nodes to the root, and the root
    upper = None
    for met in reversed(rounds):
        ready = met.filter("whole").select("gid", "level", "index", "steps", F.col("digest").alias("root"))
        if upper is not None:
            above = upper.select("gid", F.col("level").alias("top_level"), F.col("index").alias("top_index"), F.col("steps").alias("more"), "root")
            ready = ready.unionByName(met.filter("not whole").drop("root").join(above, ["gid", "top_level", "top_index"]).select("gid", "level", "index", F.concat("steps", "more").alias("steps"), "root"))
        upper = ready
    at_once = begun.filter("whole").select("part", "gid", "level", "index", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("root"))
    tops = at_once if upper is None else at_once.unionByName(begun.filter("not whole").select("part", "gid", "level", "index").join(upper, ["gid", "level", "index"]).select("part", "gid", "level", "index", "steps", "root"))
    tops = stored(tops, "tops")
    roots = ids.join(tops.groupBy("gid").agg(F.first("root").alias("root")), "gid").select(F.col("group").alias(group), "root")

    out = f"row {rows.select(*names).schema.simpleString()}, leaf string, root string, steps {STEPS}"
    schema = to_arrow_schema(held.select("row", "leaf", F.lit("").alias("root"), F.array().cast(STEPS).alias("steps")).schema)
    proved = held.groupBy("part").cogroup(tops.groupBy("part")).applyInArrow(lambda a, b: _proved(a, b, arity, schema), out)
    return proved.select("row.*", "leaf", "root", "steps"), roots


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), also: dict[str, Column] | None = None, arity: int = 2, part: int = LEAVES, fan: int = FAN) -> DataFrame:
    """order, group, leaf, subroot, root, steps of every row of `docs`, the steps through the group's tree and that over the groups; `also`: further columns, made beside the leaf."""
    rows = stored(docs.select(F.col(order), F.col(group), leaf(*fields).alias("leaf"), *(c.alias(n) for n, c in (also or {}).items())), "digests")
    proved, roots = forest(rows, group, [order], arity, part, fan)
    tops = stored(roots.select(F.lit(0).alias("all"), F.col(group).alias("_group"), F.col("root").alias("leaf")), "roots")
    over, _ = forest(tops, "all", ["_group"], arity, part, fan)
    over = stored(over.select("_group", F.col("root").alias("_root"), F.col("steps").alias("_more")), "over")
    both = proved.withColumnsRenamed({"root": "subroot", "steps": "_steps"}).join(over, F.col(group).eqNullSafe(F.col("_group")))
    return both.withColumn("root", F.col("_root")).withColumn("steps", F.concat("_steps", "_more")).drop("_steps", "_more", "_root", "_group")


def report(docs: DataFrame, every: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, after the rows whose crc32 `every` divides were tampered with: their n_chars is one more."""
    changed = leaf("doc_id", "source", "lang", (F.col("n_chars") + 1).alias("n_chars"), "text")
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % every == 0
    proved = manifest(docs, also={"_seen": F.when(hit, changed)})
    out = proved.select("doc_id", "leaf", "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), folded(F.coalesce("_seen", "leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
