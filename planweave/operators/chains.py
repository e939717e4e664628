"""Markov chains of plans by recombination: spanning trees of two merged districts, cut where both halves balance.

A chain is sequential, so Spark runs many at once, one (state, chain) a group; each
group advances a bounded number of steps and hands its state on as a row, so a long
run is a loop of short jobs that resume from what was written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave import model
from planweave.operators import trees
from planweave.session import stored


class Graph:
    """Adjacency in compressed rows, populations, and the walk's transition weights."""

    def __init__(self, nodes: np.ndarray, pop: np.ndarray, edges: np.ndarray, weight: np.ndarray, beta: float):
        self.nodes, self.pop, self.edges = nodes, pop.astype(float, copy=False), edges.astype(np.int32, copy=False)
        (u, v), n, pull = self.edges.T, len(nodes), weight**-beta
        self.to, self.pull = np.empty(2 * len(u), np.int32), np.empty(2 * len(u))
        ways = [np.argsort(x, kind="stable").astype(np.int32) for x in (u, v)]
        begin = [np.append(0, np.bincount(x, minlength=n).cumsum()) for x in (u, v)]
        self.start = begin[0] + begin[1]
        for lo in range(0, n, trees.SPAN):  # rows of some nodes at a time
            hi = min(n, lo + trees.SPAN)
            out, back = (way[at[lo] : at[hi]] for way, at in zip(ways, begin, strict=True))
            origin, to = np.append(u[out], v[back]), np.append(v[out], u[back])
            order, part = np.lexsort((to, origin)), slice(self.start[lo], self.start[hi])
            self.to[part], self.pull[part] = to[order], np.append(pull[out], pull[back])[order]

    def spanning_tree(self, inside: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Wilson's tree over the marked nodes: (parents, nodes in an order, parents first); the root is the lowest.

        Walks overwrite each node's last exit, which erases their loops. A long graph's tree is drawn
        by layers, as walks there take the square of its length; either way trees are as likely.
        Of nodes that aren't connected, only those that the root reaches are in the order.
        """
        members = np.flatnonzero(inside)
        layers = trees.layers_of(self.start, self.to, inside, members[0])
        if sum(map(len, layers)) < len(members):
            return np.full(len(self.nodes), -1), np.concatenate(layers)
        by_layers = trees.Layered(self.start, self.to, self.pull, inside, layers)
        if by_layers.shorter():
            return trees.rooted(by_layers.tree(rng), members[0], len(self.nodes))
        parent, joined = np.full(len(self.nodes), -1), np.zeros(len(self.nodes), bool)
        joined[members[0]] = True
        order, exits, options = [members[0]], {}, {}
        for begin in members:
            at = begin
            while not joined[at]:
                if at not in options:
                    part = slice(self.start[at], self.start[at + 1])
                    near = self.to[part][inside[self.to[part]]]
                    options[at] = (near, np.cumsum(self.pull[part][inside[self.to[part]]]))
                near, reach = options[at]
                exits[at] = near[min(len(near) - 1, np.searchsorted(reach, rng.random() * reach[-1], "right"))]
                at = exits[at]
            path, at = [], begin
            while not joined[at]:
                path.append(at)
                joined[at], parent[at] = True, exits[at]
                at = exits[at]
            order += path[::-1]
        return parent, np.array(order)

    def balanced_cut(self, inside: np.ndarray, ideal: float, tolerance: float, rng: np.random.Generator) -> np.ndarray | None:
        """Marks of one half of a random tree's balanced cut, or None if it has none."""
        parent, order = self.spanning_tree(inside, rng)
        if len(order) < inside.sum():
            return None
        below = self._below(inside, parent, order)
        rest = below[order[0]] - below[order]
        fine = lambda x: (x >= ideal * (1 - tolerance)) & (x <= ideal * (1 + tolerance))
        good = order[fine(below[order]) & fine(rest) & (order != order[0])]
        if not len(good):
            return None
        return self._beneath(good[rng.integers(len(good))], parent, order)

    def _below(self, inside: np.ndarray, parent: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The population of every node's subtree."""
        below, above = trees.numbers_of(np.where(inside, self.pop, 0.0)), trees.numbers_of(parent)
        for node in trees.numbers_of(order[:0:-1]):
            below[above[node]] += below[node]
        return np.frombuffer(below)

    def _beneath(self, top: int, parent: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Marks of a node's subtree."""
        half, above = bytearray(len(parent)), trees.numbers_of(parent)
        half[top] = True
        for node in trees.numbers_of(order[1:]):
            half[node] = half[node] or half[above[node]]
        return np.frombuffer(half, bool)

    def split(self, inside: np.ndarray, parts: int, ideal: float, tolerance: float, rng: np.random.Generator, label: int, out: np.ndarray, tries: int) -> bool:
        """Label `parts` districts of the marked nodes, halving them by tree cuts whose sides suit whole numbers of districts."""
        if parts == 1:
            out[inside] = label
            return True
        for _ in range(tries):
            parent, order = self.spanning_tree(inside, rng)
            if len(order) < inside.sum():
                return False
            below = self._below(inside, parent, order)
            left = parts // 2
            good = order[(np.abs(below[order] - left * ideal) <= tolerance * ideal * left) & (np.abs(below[order[0]] - below[order] - (parts - left) * ideal) <= tolerance * ideal * (parts - left)) & (order != order[0])]
            if len(good):
                half = self._beneath(good[rng.integers(len(good))], parent, order)
                del parent, order, below, good  # the parts' own come beside the mark only
                if self.split(half, left, ideal, tolerance, rng, label, out, tries) and self.split(inside & ~half, parts - left, ideal, tolerance, rng, label + left, out, tries):
                    return True
        return False

    def initial(self, k: int, rng: np.random.Generator, tolerance: float = 0.02, tries: int = 60) -> np.ndarray:
        """k districts at a tolerance that doubles, twice at most, while no partition is found."""
        out, whole, ideal = np.zeros(len(self.nodes), np.int16), np.ones(len(self.nodes), bool), self.pop.sum() / k
        for factor in (1, 2, 4):
            if self.split(whole, k, ideal, tolerance * factor, rng, 0, out, tries):
                return out
        raise ValueError("no initial partition within four times the tolerance")

    def recombine(self, plan: np.ndarray, edge: int, ideal: float, tolerance: float, rng: np.random.Generator) -> bool:
        a, b = plan[self.edges[edge]]
        inside = (plan == a) | (plan == b)
        half = self.balanced_cut(inside, ideal, tolerance, rng)
        if half is None:
            return False
        plan[inside] = np.where(half[inside], a, b)
        return True

    def step(self, plan: np.ndarray, ideal: float, rng: np.random.Generator, tolerance: float = model.POP_TOL) -> bool:
        cut = np.flatnonzero(plan[self.edges[:, 0]] != plan[self.edges[:, 1]])
        return bool(len(cut)) and self.recombine(plan, cut[rng.integers(len(cut))], ideal, tolerance, rng)

    def repair(self, plan: np.ndarray, k: int, rng: np.random.Generator, tolerance: float = model.POP_TOL, most: int = 20_000) -> float:
        """Recut the worst zone with a random neighbour until all are within the tolerance; returns the largest deviation left."""
        ideal, sums = self.pop.sum() / k, lambda: np.bincount(plan, self.pop, k)
        for _ in range(most):
            off = np.abs(sums() - ideal) / ideal
            if off.max() <= tolerance:
                break
            worst = plan[self.edges] == off.argmax()
            border = np.flatnonzero(worst[:, 0] != worst[:, 1])
            if not len(border):
                break
            edge = border[rng.integers(len(border))]
            both = sums()[plan[self.edges[edge]]].sum()
            self.recombine(plan, edge, ideal, max(1.05 * abs(both / (2 * ideal) - 1) + 1e-4, tolerance), rng)
        return float((np.abs(sums() - ideal) / ideal).max())


RECORDED = "state string, chain int, step int, accepted boolean, plan array<smallint>, after string"


def _advance(graph: Graph, k: int, steps: int, seed: int, chain: int, before: dict | None, tolerance: float, burn_in: int) -> Iterator[tuple[int, bool, np.ndarray, str | None]]:
    ideal = graph.pop.sum() / k
    if before is None:
        rng = np.random.default_rng([seed, chain])
        plan = graph.initial(k, rng)
        graph.repair(plan, k, rng, tolerance)
        for _ in range(burn_in):
            graph.step(plan, ideal, rng, tolerance)
        done = 0
    else:
        rng, plan, done = np.random.default_rng(), np.array(before["plan"], np.int16), before["done"]
        rng.bit_generator.state = before["rng"]
    for i in range(done, done + steps):
        accepted = graph.step(plan, ideal, rng, tolerance)
        last = json.dumps({"done": i + 1, "plan": plan.tolist(), "rng": rng.bit_generator.state}) if i == done + steps - 1 else None
        yield i, accepted, plan, last


def run_chains(units: DataFrame, edges: DataFrame, k: int, chains: int, steps: int, seed: int = model.SEED, tolerance: float = model.POP_TOL, burn_in: int = model.BURN_IN, beta: float | None = None, before: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """Advance every chain of every state by `steps`: state, chain, step, accepted, plan (districts in node order), after (on the last step, what resumes the chain).

    A rejected step records the plan again. units: state, node_id, pop; edges: state,
    u, v, weight. `before` has state, chain and after of the chains to resume. `packed`:
    plans are bytes, one a district or two if k is over 256. Written and read again, an
    array takes many times its size, as Spark's reader takes up to 4096 rows at a time.
    """
    beta = beta_of(k, beta)
    starts = units.select("state").distinct().select("state", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain"))
    starts = starts.join(before.select("state", "chain", "after"), ["state", "chain"], "left") if before is not None else starts.withColumn("after", F.lit(None).cast("string"))

    def run(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, after = graph_in(rows, beta)
        after = json.loads(after[0]["after"][0].as_py()) if after else None
        for i, ok, plan, last in _advance(graph, k, steps, seed, key[1].as_py(), after, tolerance, burn_in):
            districts = pa.array([plan.astype(np.uint8 if k <= 256 else "<i2").tobytes()], pa.binary()) if packed else pa.ListArray.from_arrays(pa.array([0, len(plan)], pa.int32()), pa.array(plan.copy()))
            yield pa.RecordBatch.from_pydict({"state": [key[0].as_py()], "chain": pa.array([key[1].as_py()], pa.int32()), "step": pa.array([i], pa.int32()), "accepted": [ok], "plan": districts, "after": pa.array([last], pa.string())})

    # what resumes a chain is one more row beside its graph
    beside = starts.filter("after is not null").select("state", "chain", F.lit(2).alias("kind"), *_empty(), "after")
    rows = graph_rows(units, edges, starts).withColumn("after", F.lit(None).cast("string")).unionByName(beside)
    return rows.groupBy("state", "chain").applyInArrow(run, RECORDED.replace("array<smallint>", "binary") if packed else RECORDED)


def beta_of(k: int, beta: float | None) -> float:
    return (model.BETA_FEW if k <= 2 else model.BETA_MANY) if beta is None else beta


def graph_rows(units: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Units and edges as rows of one kind, once for every chain."""
    each = starts.select("state", "chain")
    nodes = each.join(units, "state").select("state", "chain", F.lit(0).alias("kind"), F.col("node_id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("pop").cast("double").alias("x"))
    links = each.join(edges, "state").select("state", "chain", F.lit(1).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("weight").cast("double").alias("x"))
    return nodes.union(links)


def _empty() -> list[Column]:
    return [F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0.0).alias("x")]


def graph_in(batches: Iterator[pa.RecordBatch], beta: float) -> tuple[Graph, list[pa.RecordBatch]]:
    """The graph of a group's rows, and the rows of other kinds. Rows are read batch by batch and put away as numbers, so no more than the graph is held."""
    found, others = ([[], []], [[], [], []]), []
    for batch in batches:
        kind = batch["kind"].to_numpy()
        for of, (parts, columns) in enumerate(zip(found, ("ax", "abx"), strict=True)):
            for part, c in zip(parts, columns, strict=True):
                part.append(batch[c].to_numpy(zero_copy_only=False)[kind == of])
        if (kind > 1).any():
            others.append(batch.filter(pa.array(kind > 1)))

    def whole(parts: list[np.ndarray]) -> np.ndarray:
        out = np.concatenate(parts)
        parts.clear()
        return out

    nodes, pop = map(whole, found[0])
    order = np.argsort(nodes, kind="stable")
    nodes, pop = nodes[order], pop[order]
    u, v = (np.searchsorted(nodes, whole(parts)).astype(np.int32) for parts in found[1][:2])
    weight, order = whole(found[1][2]), np.lexsort((v, u))
    ends, weight = np.stack([u[order], v[order]], 1), weight[order]
    del u, v, order
    return Graph(nodes, pop, ends, weight, beta), others


#: Nodes in a batch of results.
BATCH = 1 << 16


def spanning_trees(units: DataFrame, edges: DataFrame, trees: int, seed: int = model.SEED, beta: float = model.BETA_FEW) -> DataFrame:
    """state, chain, node_id, parent: random spanning trees of every state's graph, each rooted at its lowest node (parent null)."""
    starts = units.select("state").distinct().select("state", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("chain"))

    def run(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, _ = graph_in(rows, beta)
        parent, order = graph.spanning_tree(np.ones(len(graph.nodes), bool), np.random.default_rng([seed, key[1].as_py()]))
        if len(order) < len(graph.nodes):
            raise ValueError(f"the graph of {key[0]} isn't connected")
        for at in range(0, len(parent), BATCH):
            ids, p = graph.nodes[at : at + BATCH], parent[at : at + BATCH]
            yield pa.RecordBatch.from_pydict({"state": [key[0].as_py()] * len(p), "chain": pa.array(np.full(len(p), key[1].as_py(), np.int32)), "node_id": ids, "parent": pa.array(graph.nodes[p], mask=p < 0)})

    return graph_rows(units, edges, starts).groupBy("state", "chain").applyInArrow(run, "state string, chain int, node_id long, parent long")


def repaired(units: DataFrame, edges: DataFrame, plans: DataFrame, k: int, seed: int = model.SEED, tolerance: float = model.POP_TOL, beta: float | None = None, most: int = 20_000) -> DataFrame:
    """state, node_id, zone, deviation: plans (state, node_id, zone) recut until all districts are within the tolerance, or `most` cuts are made; deviation is the largest left."""
    starts = units.select("state").distinct().withColumn("chain", F.lit(0))
    power = beta_of(k, beta)

    def run(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, own = graph_in(rows, power)
        ids, zones = (np.concatenate([x[c].to_numpy() for x in own]) for c in "ab")
        now = zones[np.argsort(ids, kind="stable")]
        del own, ids, zones
        left = graph.repair(now, k, np.random.default_rng(seed), tolerance, most)
        for at in range(0, len(now), BATCH):
            zone = now[at : at + BATCH]
            yield pa.RecordBatch.from_pydict({"state": [key[0].as_py()] * len(zone), "node_id": graph.nodes[at : at + BATCH], "zone": zone, "deviation": np.full(len(zone), left)})

    own = plans.select("state", F.lit(0).alias("chain"), F.lit(2).alias("kind"), F.col("node_id").alias("a"), F.col("zone").cast("bigint").alias("b"), F.lit(0.0).alias("x"))
    return graph_rows(units, edges, starts).unionByName(own).groupBy("state").applyInArrow(run, "state string, node_id long, zone long, deviation double")


def run_long(units: DataFrame, edges: DataFrame, k: int, chains: int, steps: int, chunk: int = model.CHUNK, **how) -> DataFrame:
    """`steps` steps in chunks, each written to the shared folder before the next begins."""
    parts, before = [], None
    for at in range(0, steps, chunk):
        part = stored(run_chains(units, edges, k, chains, min(chunk, steps - at), before=before, **how), "chain")
        parts.append(part.drop("after"))
        before = part.filter("after is not null")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def long_plans(recorded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Recorded plans as rows: chain, step, node_id, zone."""
    order = nodes.groupBy("state").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
    rows = recorded.join(order, "state").select("state", "chain", "step", F.posexplode("plan").alias("at", "zone"), "ids")
    return rows.select("state", "chain", "step", F.get("ids", F.col("at")).alias("node_id"), F.col("zone").cast("bigint").alias("zone"))
