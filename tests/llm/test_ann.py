"""Nearest neighbours against brute force."""

import numpy as np

from planweave.llm import ann

ROWS = "vec_id long, embedding array<float>, rank string"


def brute(vectors, query, k=5):
    x = np.array(vectors[query], float)
    found = sorted((-float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v)), i) for i, v in ((i, np.array(v, float)) for i, v in vectors.items()) if i != query and len(v) == len(x))
    return [(i, -s) for s, i in found[:k]]


def run(spark, rows, every=50):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], ROWS)
    out = {}
    for r in ann.report(df, every).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((10, 24))
    vectors = {i: (centres[i % 10] + 0.05 * rng.standard_normal(24) if i % 2 else rng.standard_normal(24)).astype(np.float32).tolist() for i in range(3000)}
    got = run(spark, list(vectors.items()))
    assert set(got) == set(range(0, 3000, 50))
    hits = 0
    for q, found in got.items():
        expected = brute(vectors, q)
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        hits += len({i for i, _ in expected} & {i for _, i, _ in found})
        for _, i, s in found:
            a, b = np.array(vectors[q], float), np.array(vectors[i], float)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert hits / (5 * len(got)) >= 0.9


def test_copies_ties_and_bad_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 400, 2)] + [(1, [2.0, 4.0, 6.5]), (3, [-1.0, 0.0, 1.0])]
    rows += [(50, [1.0, 2.0, 3.0]), (7, None), (9, [0.0, 0.0, 0.0]), (11, [1.0, None, 2.0]), (13, [float("nan"), 1.0, 1.0]), (15, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (17, []), (600, [1.0, 1.0]), (601, [2.0, 1.0]), (650, None)]
    got = run(spark, rows)
    assert set(got) == {0, 50, 100, 150, 200, 250, 300, 350, 600}
    assert [i for _, i, _ in got[0]] == [2, 4, 6, 8, 10] and [i for _, i, _ in got[300]] == [0, 2, 4, 6, 8]
    assert [i for _, i, _ in got[600]] == [601]
    assert run(spark, [(50, [1.0, 0.0])]) == {}
    assert ann.report(spark.createDataFrame([], ROWS)).count() == 0


def found_in(vectors, every, certain=ann.CERTAIN):
    """Recall of one shard's forest, and the share of its rows that a query scores on its way up."""
    forest, at = ann.Forest(vectors, np.arange(len(vectors))), np.arange(0, len(vectors), every)
    wanted = ann.unit(vectors[at])
    near = wanted.astype(np.float32)
    down = [forest.best(q, places, 6) for q, places in zip(wanted, forest.down(near), strict=True)]
    least = np.array([x[-1][1] if len(x) == 6 else np.nan for x in down])
    hits = scored = 0
    for i, q, places, first in zip(at, wanted, forest.up(near, *ann.rising(vectors.shape[1], least, certain)), down, strict=True):
        scored += len(places)
        got = sorted({*forest.best(q, places, 6), *first}, key=lambda x: -x[1])
        exact = ann.unit(vectors) @ q
        exact[i] = -2
        hits += len({p for p, _ in got if p != i} & set(np.argsort(-exact)[:5].tolist()))
    return hits / 5 / len(at), scored / len(at) / len(vectors)


def test_recall_and_rows_scored():
    """0.9 of the neighbours for under a quarter of the rows, where vectors are clustered and where nothing tells them apart."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 48))
    clustered = (centres[np.arange(6000) % 40] + 0.4 * rng.standard_normal((6000, 48))).astype(np.float32)
    given = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), np.float32)
    for vectors in (clustered, given):
        recall, scored = found_in(vectors, 20)
        assert recall >= 0.9 and scored < 0.25, (recall, scored)
    assert found_in(given, 50, certain=1.0) == (1.0, 1.0)


def test_query_recall_and_exact_way(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r.vec_id: r.embedding for r in given.collect()}
    key = lambda df: sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in df.collect())
    exact = sorted((q, n + 1, i, round(s, 12)) for q in vectors if q % 50 == 0 for n, (i, s) in enumerate(brute(vectors, q)))
    got = key(ann.report(given))
    assert len({x[0::2] for x in got} & {x[0::2] for x in exact}) >= 0.9 * len(exact)
    assert key(ann.search(given, given.filter("vec_id % 50 = 0"), certain=1.0)) == exact


def test_magnitudes(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 2e-300]), (2, [-1.0, 1.0]), (50, [3e200, 3.1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.report(df).collect()}
    assert [got[0, i][0] for i in (1, 2, 3)] == [50, 1, 2] and abs(got[0, 2][1] - 3 / 10**0.5) < 1e-12 and abs(got[0, 3][1]) < 1e-12
