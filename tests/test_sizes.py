"""What has to hold for tables to grow: joins of exploded rows, long graphs, packed plans."""

import cProfile
import itertools
import math
import os
import threading
import time
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from planweave.operators import chains, graph, metrics, outline, spatial, trees
from planweave.plans import catalogue, surrogate

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_segments_are_not_broadcast(spark):
    adjacent = catalogue.QUERIES["adjacency_of_bricks"](spark, SF)
    assert "Broadcast" not in plan_of(adjacent) and adjacent.count() > 0


def test_segments_and_their_owners_are_not_broadcast(spark):
    dissolved = catalogue.QUERIES["dissolve_bricks"](spark, SF)
    assert "Broadcast" not in plan_of(dissolved) and dissolved.count() > 0


def strip(width, length, seed=1, beta=1.0):
    n = np.arange(width * length)
    edges = np.concatenate([np.stack([n[n % width < width - 1], n[n % width < width - 1] + 1], 1), np.stack([n[:-width], n[width:]], 1)])
    return chains.Graph(n, np.ones(len(n)), edges, np.random.default_rng(seed).integers(1, 30, len(edges)).astype(float), beta)


def test_trees_by_layers_are_as_likely_as_their_weights():
    g, n, draws = strip(2, 4), 8, 20_000
    weight = {(min(i, j), max(i, j)): p for i in range(n) for j, p in zip(g.to[g.start[i] : g.start[i + 1]].tolist(), g.pull[g.start[i] : g.start[i + 1]], strict=True)}
    likely = {}
    for chosen in itertools.combinations(weight, n - 1):
        label = list(range(n))
        for a, b in chosen:
            label = [label[b] if x == label[a] else x for x in label]
        if len(set(label)) == 1 and len({tuple(e) for e in chosen}) == n - 1:
            likely[frozenset(chosen)] = math.prod(weight[e] for e in chosen)
    inside = np.ones(n, bool)
    rows, rng = trees.Layered(g.start, g.to, g.pull, inside, trees.layers_of(g.start, g.to, inside, 0)), np.random.default_rng(5)
    seen = Counter(frozenset((min(e), max(e)) for e in rows.tree(rng).tolist()) for _ in range(draws))
    total = sum(likely.values())
    assert len(likely) == 56 and set(seen) <= set(likely)
    assert sum((seen[t] - draws * p / total) ** 2 / (draws * p / total) for t, p in likely.items()) < 100  # 55 degrees of freedom


def test_a_long_graph_takes_no_square_of_its_length():
    g, began = strip(2, 10_000), time.time()
    parent, order = g.spanning_tree(np.ones(20_000, bool), np.random.default_rng(1))
    assert time.time() - began < 60  # walks: about 3e8 steps
    place = np.empty(20_000, int)
    place[order] = np.arange(20_000)
    near = [set(g.to[g.start[i] : g.start[i + 1]].tolist()) for i in range(20_000)]
    assert order[0] == 0 and parent[0] == -1 and all(parent[i] in near[i] and place[parent[i]] < place[i] for i in range(1, 20_000))


def test_a_long_graphs_tree_takes_few_calls_a_node():
    g, inside = strip(20, 500), np.ones(10_000, bool)
    rows, profile = trees.Layered(g.start, g.to, g.pull, inside, trees.layers_of(g.start, g.to, inside, 0)), cProfile.Profile()
    edges = profile.runcall(rows.tree, np.random.default_rng(1))
    assert len(edges) == 9_999
    assert sum(x.callcount for x in profile.getstats()) < 45 * 10_000


def test_a_layers_walks_are_to_its_heaviest_piece(monkeypatch):
    g, inside, roots, through = strip(20, 300), np.ones(6_000, bool), [], trees.walked
    rows = trees.Layered(g.start, g.to, g.pull, inside, trees.layers_of(g.start, g.to, inside, 0))
    monkeypatch.setattr(trees, "walked", lambda reach, draws, root=0: roots.append(reach[root][-1] >= reach[0][-1]) or through(reach, draws, root))
    profile = cProfile.Profile()
    edges = profile.runcall(rows.tree, np.random.default_rng(1))
    assert len(edges) == 5_999 and all(roots)
    assert sum(x.callcount for x in profile.getstats()) < 31 * 6_000


def test_the_whole_run_goes_beside_the_one_in_parts(spark, monkeypatch):
    began, through = [], chains.run_chains
    monkeypatch.setattr(chains, "run_chains", lambda *a, **k: began.append(threading.get_ident()) or through(*a, **k))
    found = catalogue.QUERIES["resume_equivalence"](spark, SF)
    assert sorted(map(tuple, found.select("state", "steps", "differing").collect())) == [("A", 20, 0), ("B", 20, 0)]
    assert len(began) == 4 and len(set(began)) == 2


def test_pieces_that_are_not_connected_are_told():
    g = chains.Graph(np.arange(4), np.ones(4), np.array([[0, 1], [2, 3]]), np.ones(2), 1.0)
    assert g.spanning_tree(np.ones(4, bool), np.random.default_rng(1))[1].tolist() == [0, 1]


def test_plans_are_made_by_many_tasks_and_packed_ones_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(surrogate, "UNITS", 40)
    s = surrogate.Surrogate(spark, SF)
    assert s.plans.rdd.getNumPartitions() == -(-s.grid.count() // 40) > 1
    rows = sorted(map(tuple, s.plans.select("step", "node_id", "zone").collect()))
    assert rows == sorted(map(tuple, metrics.unpacked(s.packed).collect()))
    assert "_of" in metrics.packed(s.packed).columns and s.packed is s.packed
    county = s.units.select("node_id", "county")
    both = [sorted(map(str, metrics.with_units(p, county).select("step", "node_id", "zone", "county").collect())) for p in (s.plans, s.packed)]
    assert both[0] == both[1]


def test_only_rings_that_may_hold_a_hole_are_looked_at(spark, monkeypatch):
    def square(x, y, side, hole=False):
        corners = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
        return [{"x": 1e7 + a, "y": 5e6 + b} for a, b in (corners[::-1] if hole else corners)]

    rows = [(1, square(0.0, 0.0, 3.0)), (1, square(1.0, 1.0, 1.0, hole=True)), (1, square(9.0, 0.0, 1.0)), (2, square(0.0, 0.0, 3.0)), (None, square(0.0, 0.0, 2.0)), (None, square(0.5, 0.5, 1.0, hole=True))]
    looked_at, through = [], spatial.points_in_polygons
    monkeypatch.setattr(spatial, "points_in_polygons", lambda points, polygons, *a, **k: looked_at.append(polygons.count()) or through(points, polygons, *a, **k))
    parts = outline.parts(spark.createDataFrame(rows, "g int, points array<struct<x:double,y:double>>"), ["g"]).collect()
    assert sorted((r.g or 0, len(r.geom), abs(r.geom[0][1].x - r.geom[0][0].x)) for r in parts) == [(0, 2, 2.0), (1, 1, 1.0), (1, 2, 3.0), (2, 1, 3.0)]
    assert looked_at == [2]


def test_wide_plans_are_put_together_packed(spark):
    found = catalogue.QUERIES["wide_to_long_plans"](spark, SF)
    assert "pivotfirst" not in plan_of(found)
    rows = sorted(map(tuple, found.select("step", "node_id", "zone").collect()))
    assert rows == sorted(map(tuple, surrogate.Surrogate(spark, SF).plans.select("step", "node_id", "zone").collect()))


def test_centres_are_looked_for_once_for_all_plans(spark):
    found = catalogue.QUERIES["units_in_zones"](spark, SF)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found) and "sides#" in plan_of(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, surrogate.Surrogate(spark, SF).plans.select("step", "node_id", "zone").collect()))


def test_sides_are_dealt_out_by_their_number_to_be_walked_around(spark, monkeypatch):
    monkeypatch.setattr(outline, "DEALT", 4)
    corner = lambda x, y: {"x": float(x), "y": float(y)}
    # two squares a group that meet at a corner
    rows = [(g, corner(*a), corner(*b)) for g in range(3) for o in (0, 1) for a, b in itertools.pairwise([(o, o), (o + 1, o), (o + 1, o + 1), (o, o + 1), (o, o)])]
    found = outline.stitched(spark.createDataFrame(rows, "g int, p struct<x:double,y:double>, q struct<x:double,y:double>"), ["g"])
    assert found.rdd.getNumPartitions() == 6
    assert sorted((r.g, len(r.points)) for r in found.collect()) == [(g, 4) for g in range(3) for _ in range(2)]


def test_lists_of_owners_are_not_compared_with_each_other_whole(spark):
    node = [(0, 0), (1, 0)]
    for plans in ([(s, n, n * (s % 2)) for s in range(4) for n in range(2)], [(s, n, n * (s % 2)) for s in range(4) for n in range(2) if (s, n) != (2, 1)]):
        segments = spark.createDataFrame([(n, o, a, b, 1.0) for n, (x, y) in enumerate(node) for o, a, b in (("V", x, y), ("V", x + 1, y), ("H", x, y), ("H", x, y + 1))], "node_id int, o string, a int, b int, len_m double")
        found = graph.plan_perimeters(segments, spark.createDataFrame(plans, "step int, node_id int, zone int"), "node_id", ["o", "a", "b"])
        owned = Counter((s, z) for s, n, z in plans)
        assert sorted(map(tuple, found.collect())) == sorted((s, z, 4.0 if n == 1 else 6.0) for (s, z), n in owned.items())
        assert "zip_with" in plan_of(found)


def test_edges_and_steps_are_rows_without_structs_or_decimals(spark):
    s = surrogate.Surrogate(spark, SF)
    marked = plan_of(metrics.cut_marks(s.edges, s.packed))
    assert "posexplode(" in marked and "Generate explode(" not in marked
    assert "inline(" not in plan_of(metrics.with_units(s.packed, s.units.select("node_id", "county")))
    generated = [x for x in plan_of(s.plans).splitlines() if "AS zone" in x]
    assert generated and not any("decimal" in x for x in generated)


def test_ancestors_that_are_no_units_hold_their_descendants(spark, tmp_path):
    duckdb.sql(f"copy (select * from '{SF}/customer.parquet' where c_custkey % 7 <> 3 and c_custkey not in (0, 1, 4) union all select * replace (c_custkey + 9000 as c_custkey) from '{SF}/customer.parquet' union all select * from '{SF}/customer.parquet' where c_custkey = 5) to '{tmp_path}/customer.parquet' (format parquet)")
    con = duckdb.connect()
    for t in ("customer", "orders", "nation"):
        con.sql(f"create view {t} as select * from '{tmp_path if t == 'customer' else SF}/{t}.parquet'")
    found = catalogue.QUERIES["tree_cut"](spark, str(tmp_path)).select("node", "subtree_pop").collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(f"select node, subtree_pop from ({catalogue.SQL['tree_cut']})").fetchall())
    held = graph.subtree_sums(spark.createDataFrame([(5, 1, 2), (6, 1, 3), (7, 5, 4)], "node long, parent long, pop long"))
    assert sorted(map(tuple, held.collect())) == [(1, 9), (5, 6), (6, 3), (7, 4)]


def test_a_long_graphs_tree_takes_few_bytes_a_node(monkeypatch):
    g, inside = strip(20, 1_000), np.ones(20_000, bool)
    whole = g.spanning_tree(inside, np.random.default_rng(1))
    for name, x in {"KEPT": 1 << 14, "SPAN": 1 << 10}.items():
        monkeypatch.setattr(trees, name, x, raising=False)
    tracemalloc.start()
    parent, order = g.spanning_tree(inside, np.random.default_rng(1))
    g._beneath(order[1], parent, order)
    g._below(inside, parent, order)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * 20_000
    assert (parent == whole[0]).all() and (order == whole[1]).all()


def test_a_graphs_rows_are_read_without_being_held():
    g, size, held = strip(20, 5_000), 10_000, []
    n = len(g.nodes)
    rows = [np.repeat([0, 1], [n, len(g.edges)]), np.concatenate([g.nodes, g.edges[:, 0]]), np.concatenate([0 * g.nodes, g.edges[:, 1]]), np.ones(n + len(g.edges))]
    rows[0][-1] = 2

    def batches():
        for at in range(0, len(rows[0]), size):
            held.append(pa.total_allocated_bytes())
            buffers = [pa.array(x[at : at + size].tolist()) for x in rows]
            yield pa.RecordBatch.from_arrays(buffers, names=["kind", "a", "b", "x"])

    got, others = chains.graph_in(batches(), 1.0)
    assert max(held[2:]) - held[0] < 4 * size * 8 * 4
    assert [x.num_rows for x in others] == [1] and (got.nodes == g.nodes).all() and got.edges.tolist() == sorted(g.edges[:-1].tolist())


def test_packed_plans_are_the_same_and_no_arrays_are_written(spark, monkeypatch):
    units, edges = catalogue.halves(surrogate.Surrogate(spark, SF))
    how = {"beta": 0.5, "tolerance": 0.05, "burn_in": 0}
    arrays, packed = (chains.run_chains(units, edges, 4, 1, 2, packed=p, **how).drop("after").collect() for p in (False, True))
    assert sorted((r.state, r.step, tuple(r.plan)) for r in arrays) == sorted((r.state, r.step, tuple(r.plan)) for r in packed)
    written, through = [], catalogue.stored
    monkeypatch.setattr(catalogue, "stored", lambda df, name="table": written.append(dict(df.dtypes).get("plan")) or through(df, name))
    assert {r.differing for r in catalogue.QUERIES["resume_equivalence"](spark, SF).collect()} == {0}
    assert written.count("binary") == 1 and not any("array" in str(x) for x in written)


def row_of_squares(spark, n):
    ring = lambda x: [[{"x": x, "y": 0.0}, {"x": x + 1, "y": 0.0}, {"x": x + 1, "y": 1.0}, {"x": x, "y": 1.0}]]
    return spark.createDataFrame([(i, ring(float(i))) for i in range(n)], "node_id int, geom array<array<struct<x:double,y:double>>>")


def test_districts_meet_sides_as_arrays_of_steps_and_zones(spark, monkeypatch):
    seen, through = [], outline.stitched
    monkeypatch.setattr(outline, "stitched", lambda sides, group: seen.append(plan_of(sides)) or through(sides, group))
    # all in one zone, apart, a zone that is null, and steps in which a node has none
    plans = spark.createDataFrame([(0, n, 5) for n in range(4)] + [(1, n, n % 2) for n in range(4)] + [(2, n, None if n < 2 else 1) for n in range(4)] + [(3, n, 0) for n in (0, 2, 3)], "step int, node_id int, zone int")
    polygons = row_of_squares(spark, 4)
    key = lambda r: (r.step, -1 if r.zone is None else r.zone, sorted((p.x, p.y) for ring in r.geom for p in ring))
    found = sorted(map(key, outline.dissolved_plans(polygons, plans, "node_id").collect()))
    listed = [x for x in seen[0].splitlines() if "collect_list" in x and "_low" in x]
    assert listed and not any("transform" in x for x in listed)
    assert found == sorted(map(key, outline.dissolved(polygons, plans, "node_id", ["step", "zone"]).collect())) and len(found) == 9


def test_small_cells_are_parted_where_they_are(spark, monkeypatch):
    n = 400
    star = [{"x": math.cos(i * 2 * math.pi / n) * (90 + 20 * (i % 2)), "y": math.sin(i * 2 * math.pi / n) * (90 + 20 * (i % 2))} for i in range(n)]
    polygons = spark.createDataFrame([(1, [star])], "id int, geom array<array<struct<x:double,y:double>>>")
    rounds, through, cells = [], spatial.stored, []
    monkeypatch.setattr(spatial, "stored", lambda df, name: rounds.append(name) or through(df, name))
    for dealt, times in ((1000, 1), (0, 2)):
        monkeypatch.setattr(spatial, "DEALT", dealt, raising=False)
        monkeypatch.setattr(spatial, "CELLS", 7, raising=False)
        rounds.clear()
        cells.append(sorted((c.level, c.cx, c.cy, c.inside, sorted(c.sides)) for c in spatial.cover(polygons, ["id"], 4, 8).collect()))
        assert len(rounds) == times
    assert cells[0] == cells[1] and len(cells[0]) > 100


def test_polygons_meet_their_districts_before_they_are_sides(spark, monkeypatch):
    seen, through = [], outline.stitched
    monkeypatch.setattr(outline, "stitched", lambda sides, group: seen.append(plan_of(sides)) or through(sides, group))
    plans = spark.createDataFrame([(0, n, n % 2) for n in range(3)], "step int, node_id int, zone int")
    found = outline.dissolved_plans(row_of_squares(spark, 3), plans, "node_id").collect()
    assert "explode" not in seen[0][seen[0].index("SortMergeJoin") :] and sorted(r.zone for r in found) == [0, 0, 1]


def test_rings_are_not_sent_about_where_few_have_holes(spark):
    square = lambda x, side: [{"x": x, "y": x}, {"x": x + side, "y": x}, {"x": x + side, "y": x + side}, {"x": x, "y": x + side}]
    rows = [(g, square(10.0 * i, 3.0)) for g in range(5) for i in range(20)] + [(0, square(1.0, 1.0)[::-1]), (None, square(0.0, 3.0)), (None, square(1.0, 1.0)[::-1])]
    for some, holes in ((rows, 2), (rows[:100], 0)):
        found = outline.parts(spark.createDataFrame(some, "g int, points array<struct<x:double,y:double>>"), ["g"])
        assert "hashpartitioning" not in plan_of(found)
        sizes = Counter(len(r.geom) for r in found.collect())
        assert sizes[2] == holes and sizes[1] + sizes[2] == len(some) - holes


def test_sides_are_sent_without_structs_to_be_walked_around(spark):
    corner = lambda x, y: {"x": float(x), "y": float(y)}
    rows = [(g, corner(*a), corner(*b)) for g in (1, None) for a, b in itertools.pairwise([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])]
    found = outline.stitched(spark.createDataFrame(rows, "g int, p struct<x:double,y:double>, q struct<x:double,y:double>"), ["g"])
    plan = plan_of(found)
    assert "_xp" in plan[plan.index("Exchange") :]
    assert sorted((r.g or 0, len(r.points)) for r in found.collect()) == [(0, 4), (1, 4)]


def test_segments_travel_once_to_their_cells_and_once_to_their_keys(spark):
    point = lambda x, y: {"x": float(x), "y": float(y)}
    # a long side over three short ones, there twice and once without a key, and a short one twice
    rows = [(k, point(0, 0), point(300, 0)) for k in (1, 1, None)] + [(2, point(100 * i, 0), point(100 * i + 100, 0)) for i in (0, 1, 1, 2)]
    segments = spark.createDataFrame(rows, "id int, p struct<x:double,y:double>, q struct<x:double,y:double>")
    cut = graph.split_segments(segments, "id", 70.0)
    pieces = Counter((r.id, r.p.x, r.q.x, r.len_m) for r in cut.collect())
    whole = [(1, 100.0 * i, 100.0 * i + 100, 100.0) for i in range(3)] * 2 + [(None, 0.0, 300.0, 300.0)]
    assert pieces == Counter(whole + [(2, 100.0 * i, 100.0 * i + 100, 100.0) for i in (0, 1, 1, 2)])
    owners = spark.createDataFrame([(1, 0), (2, 0)], "id int, g int")
    found = graph.dissolved_boundary(cut, owners, "id", ["g"], ["p", "q"])
    assert plan_of(found).count("Exchange hashpartitioning") == 7
    assert found.first().perimeter_m == 200  # three owners of the outer two, four of the middle one
