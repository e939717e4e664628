"""Approximate nearest neighbours by cosine: a hash-prefix forest.

Each of TREES trees gives every vector a string of SYMBOLS symbols, each the axis (and
its sign) of a random rotation that the vector lies nearest to. Rows are dealt out by
hash to shards of about one size; a shard holds its own rows' strings, tree by tree in
sorted order, and every query goes to all shards, in blocks of BLOCK queries. So a
vector travels once a search, whatever the number of trees, and no shard is hot.

A search goes down and up again:

* down: in every tree a query looks at the entries around its place in the sorted
  strings, which are those with the longest common prefixes, and scores them;
* up: all trees go up together to the depth, and to the number of trees that have to
  agree on a candidate, at which a vector as near as the least of the results so far is
  found with probability CERTAIN; every entry that so many trees have under the query's
  prefix of that depth is scored. At the last symbol of the prefix the query's PROBES
  nearest axes count. Of the depths and numbers that are certain enough, that is taken
  for which the fewest unrelated vectors are scored; a query for which there is none,
  or that has too few results, goes up to the root, which is the exact way: all rows.

So well-separated queries stay deep and vague ones widen, and nothing caps candidates.
`certain=1.0` makes every query exact. Equal vectors are one entry with its smallest
ids (more can't be among the results), queries with equal vectors are searched once.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows
without vec_id take no part; vectors of another length are in a forest of their own;
repeated rows count once. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweave.session import stored

TREES, SYMBOLS = 48, 4
#: Axes of a rotation at most; longer vectors are projected on so many.
AXES = 64
PROBES = 3
#: Rows of a shard at most, and at least while there are fewer shards than cores; queries of a block.
SHARD, LEAST_SHARD, BLOCK = 1 << 16, 2048, 1 << 14
#: Entries on either side that a query looks at on its way down.
AROUND = 12
CERTAIN = 0.9
SEED = 20240229
#: Share of a score's cost that one entry under a prefix costs.
LOOKED_AT = 0.05


@functools.lru_cache(2)
def rotations(size: int) -> np.ndarray:
    """For each tree the rotations of its symbols, side by side: (TREES, size, SYMBOLS * axes)."""
    rng = np.random.default_rng([SEED, size])
    axes = min(size, AXES)
    out = np.empty((TREES, size, SYMBOLS * axes), np.float32)
    for tree in range(TREES):
        for at in range(SYMBOLS):
            random = rng.standard_normal((size, axes))
            out[tree, :, at * axes : (at + 1) * axes] = np.linalg.qr(random)[0] if size == axes else random
    return out


def symbols(vectors: np.ndarray, tree: int, probes: int = 1) -> np.ndarray:
    """The `probes` nearest axes of each vector at each symbol of a tree, nearest first: (n, SYMBOLS, probes)."""
    size = vectors.shape[1]
    axes = min(size, AXES)
    probes = min(probes, 2 * axes)
    out = np.empty((len(vectors), SYMBOLS, probes), np.int64)
    for begin in range(0, len(vectors), 8192):
        part = slice(begin, begin + 8192)
        along = (vectors[part] @ rotations(size)[tree]).reshape(-1, SYMBOLS, axes)
        if probes == 1:
            nearest = np.abs(along).argmax(axis=2)[..., None]
            out[part] = 2 * nearest + (np.take_along_axis(along, nearest, 2) < 0)
        else:
            signed = np.stack([along, -along], axis=3).reshape(*along.shape[:2], 2 * axes)
            out[part] = np.argsort(-signed, axis=2, kind="stable")[..., :probes]
    return out


def chances(size: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosines, and for each the chance that two vectors so near share a symbol, and that one has the other's among its `probes`."""
    axes = min(size, AXES)
    rng = np.random.default_rng([SEED, size, probes])
    a, other = rng.standard_normal((2, 4000, axes))
    ranks = lambda v: np.concatenate([v, -v], axis=1)
    mine = np.argsort(-ranks(a), axis=1)[:, : min(probes, 2 * axes)]
    cosines, same, among = np.linspace(0, 1, 51), [], []
    for c in cosines:
        theirs = ranks(c * a + math.sqrt(1 - c * c) * other).argmax(axis=1)
        same.append((theirs == mine[:, 0]).mean())
        among.append((theirs[:, None] == mine).any(axis=1).mean())
    return cosines, np.array(same), np.array(among)


def at_least(n: int, p: float) -> np.ndarray:
    """The chance that 1, 2, ... n of n trials of chance p succeed."""
    p = min(max(p, 0.0), 1.0)
    each = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    return np.clip(1 - np.cumsum(each)[:-1], 0, 1)


@functools.lru_cache(64)
def ascents(size: int, certain: float) -> tuple[np.ndarray, np.ndarray]:
    """By a score's place among the cosines of `chances`: the depth to go up to (0: the root) and the trees that must agree there."""
    axes = min(size, AXES)
    cosines, same, among = chances(size)
    depth, agree = np.zeros(len(cosines), int), np.ones(len(cosines), int)
    for i in range(len(cosines)):
        least = 1.0
        for x in range(1, SYMBOLS + 1):
            found = at_least(TREES, same[i] ** (x - 1) * among[i])
            by_chance = min(1.0, (1 / (2 * axes)) ** (x - 1) * PROBES / (2 * axes))
            cost = at_least(TREES, by_chance) + LOOKED_AT * TREES * by_chance
            cost = np.where(found >= certain, cost, np.inf)
            if certain < 1 and cost.min() < least:
                least, depth[i], agree[i] = cost.min(), x, int(cost.argmin()) + 1
    return depth, agree


def unit(vectors: np.ndarray) -> np.ndarray:
    """Of length 1, whatever their magnitude."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Forest:
    """The trees of one shard: places of its rows in the order of their strings."""

    def __init__(self, vectors: np.ndarray, reps: np.ndarray):
        self.exact, self.reps = unit(vectors), reps
        self.vectors = self.exact.astype(np.float32)
        self.base = 2 * min(vectors.shape[1], AXES)
        self.orders, self.strings = [], []
        for tree in range(TREES):
            string = self.string(symbols(self.vectors, tree)[..., 0], SYMBOLS)
            order = np.argsort(string, kind="stable")
            self.orders.append(order.astype(np.int32))
            self.strings.append(string[order])

    def string(self, found: np.ndarray, depth: int) -> np.ndarray:
        """The first symbols as one number, with as many zeros after them as make a whole string."""
        out = np.zeros(found.shape[0], np.int64)
        for at in range(SYMBOLS):
            out = out * self.base + (found[:, at] if at < depth else 0)
        return out

    def best(self, query: np.ndarray, places: np.ndarray, keep: int) -> list[tuple[int, float]]:
        """Of the rows at `places` the `keep` nearest, ties to smaller ids: places and cosines, in double precision where it matters."""
        rough = self.vectors[places] @ query.astype(np.float32)
        if len(places) > keep:
            places = places[rough >= np.partition(rough, -keep)[-keep] - 1e-5]
        scores = self.exact[places] @ query
        first = np.lexsort((self.reps[places], -scores))[:keep]
        return list(zip(places[first].tolist(), scores[first].tolist(), strict=True))

    def down(self, queries: np.ndarray) -> list[np.ndarray]:
        """Places around each query's in every tree."""
        near, n = np.arange(-AROUND, AROUND), len(self.reps)
        found = []
        for tree in range(TREES):
            at = np.searchsorted(self.strings[tree], self.string(symbols(queries, tree)[..., 0], SYMBOLS))
            found.append(self.orders[tree][np.clip(at[:, None] + near, 0, n - 1)])
        return [np.unique(row) for row in np.concatenate(found, axis=1)]

    def up(self, queries: np.ndarray, depth: np.ndarray, agree: np.ndarray):
        """Places under each query's prefix of its depth in as many trees as must agree; all at depth 0."""
        n = len(self.reps)
        parts: list[list[np.ndarray]] = [[] for _ in queries]
        for tree in range(TREES):
            found, order, strings = symbols(queries, tree, PROBES), self.orders[tree], self.strings[tree]
            for x in np.unique(depth[depth > 0]).tolist():
                rows, under = np.flatnonzero(depth == x), self.base ** (SYMBOLS - x)
                for probe in range(found.shape[2]):
                    mine = found[rows, :, 0].copy()
                    mine[:, x - 1] = found[rows, x - 1, probe]
                    start = self.string(mine, x)
                    low, high = np.searchsorted(strings, start), np.searchsorted(strings, start + under)
                    for k in np.flatnonzero(low < high).tolist():
                        parts[rows[k]].append(order[low[k] : high[k]])
        for i, part in enumerate(parts):
            if depth[i] == 0:
                yield np.arange(n)
            else:
                yield np.flatnonzero(np.bincount(np.concatenate(part), minlength=n) >= agree[i]) if part else np.arange(0)


def rising(size: int, scores: np.ndarray, certain: float) -> tuple[np.ndarray, np.ndarray]:
    """Depth and agreement for queries whose least result so far has these scores; to the root where there is none."""
    depth, agree = ascents(size, certain)
    at = np.clip(np.floor(np.nan_to_num(scores, nan=-1.0) * (len(depth) - 1)), -1, len(depth) - 1).astype(int)
    return np.where(at < 0, 0, depth[at]), agree[at]


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """embedding, rep (its least id), ids (its `keep` least): one row for each distinct vector."""
    least = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    one = rows.withColumn("nth", least).filter(F.col("nth") <= keep).groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return one.select("embedding", F.col("ids")[0].alias("rep"), "ids")


def valid(rows: DataFrame, kind: str = "array<double>") -> DataFrame:
    x = F.col("embedding").cast(kind)
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return rows.select("vec_id", x.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


FOUND = "query long, rep long, ids array<long>, score double"


def _stacked(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray | pa.LargeListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _searched(shards: DataFrame, queries: DataFrame, keep: int, certain: float | None) -> DataFrame:
    """The best of every shard for its queries, down or (with `certain`) up; queries: rep, embedding, and on the way up score."""
    keys = ["size", "part", "block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            forest = Forest(_stacked(left["embedding"], left.num_rows), left["rep"].to_numpy())
            wanted, asked = unit(_stacked(right["embedding"], right.num_rows)), right["rep"].to_pylist()
            for begin in range(0, len(asked), 256):
                some = wanted[begin : begin + 256]
                if certain is None:
                    found = forest.down(some.astype(np.float32))
                else:
                    scores = right["score"].slice(begin, 256).to_numpy().astype(float)
                    found = forest.up(some.astype(np.float32), *rising(some.shape[1], scores, certain))
                for query, who, places in zip(some, asked[begin : begin + 256], found, strict=True):
                    rows += [(who, place, score) for place, score in forest.best(query, places, keep)]
        who, places, scores = zip(*rows, strict=True) if rows else ((), (), ())
        at = pa.array(places, pa.int64())
        ids = left["ids"].combine_chunks().take(at) if rows else pa.array([], pa.list_(pa.int64()))
        return pa.table({"query": pa.array(who, pa.int64()), "rep": left["rep"].combine_chunks().take(at) if rows else pa.array([], pa.int64()), "ids": ids, "score": pa.array(scores, pa.float64())})

    return _merged(shards.groupBy(keys).cogroup(queries.groupBy(keys)).applyInArrow(search, FOUND), keep)


def _merged(found: DataFrame, keep: int) -> DataFrame:
    once = found.groupBy("query", "rep").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    return once.withColumn("nth", best).filter(F.col("nth") <= keep).select("query", "rep", "ids", "score", "nth")


def search(rows: DataFrame, asked: DataFrame, k: int = 5, certain: float = CERTAIN) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of `asked` (vec_id, embedding) its `k` nearest other rows."""
    keep = k + 1  # the query itself may be among them
    floats = all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (rows, asked))
    kind = "array<float>" if floats else "array<double>"
    rows, asked = valid(rows, kind), valid(asked, kind)
    forest = stored(entries(rows, keep), "forest")
    queries = stored(forest.join(asked.select("embedding").distinct(), "embedding", "left_semi").select("rep", "embedding"), "queries")
    n, many = forest.count(), queries.count()
    parts = max(-(-n // SHARD), min(-(-n // LEAST_SHARD), 2 * rows.sparkSession.sparkContext.defaultParallelism), 1)
    blocks = max(1, -(-many // BLOCK))

    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    size = F.size("embedding").alias("size")
    shards = forest.select("rep", "ids", "embedding", size, dealt(parts).alias("part"), all_of(blocks).alias("block"))
    sent = lambda df: df.withColumns({"size": F.size("embedding"), "block": dealt(blocks), "part": all_of(parts)})
    down = stored(_searched(shards, sent(queries), keep, None), "down")
    least = down.filter(F.col("nth") == keep).select(F.col("query").alias("rep"), "score")
    up = _searched(shards, sent(queries.join(least, "rep", "left")), keep, certain)
    best = _merged(up.drop("nth").unionByName(down.drop("nth")), keep)

    ids = best.withColumn("vec_id", F.explode("ids"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    lists = ids.withColumn("nth", nth).filter(F.col("nth") <= keep).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    # written first: both sides of the last join are shuffled, so a vector that many queries share can be split
    lists = stored(queries.select("embedding", F.col("rep").alias("query")).join(lists, "query").select("embedding", "found"), "neighbours")
    out = asked.distinct().join(lists, "embedding").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("found"))
    return out.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def report(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    return search(rows, rows.filter(F.col("vec_id") % every == 0), k)
