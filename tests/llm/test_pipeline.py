"""The pipeline against a plain version of its decisions on one small table."""

import re

import corpus_pipeline as cp
from planweave.llm import packing, quality, secrets, simhash, toxicity
from planweave.llm.common import table
from test_models import corpus


def test_stages(spark, tmp_path):
    rows, labels = corpus(200)
    rows += [(300, rows[1][1]), (301, rows[1][1]), (302, "Sit conat dolor amem ipsur. " * 3 + 'Ipsis token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (303, None), (303, None), (304, "")]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra double").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")

    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == list(cp.COLUMNS) and out.dtypes == docs.select(*cp.COLUMNS).dtypes
        path = f"{d}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    raw = spark.read.parquet(f"{d}/documents.parquet")

    model = quality.fitted(raw, table(spark, d, "labels", "doc_id", "quality"))
    known = quality.Features()
    tail = lambda t: model.tails(__import__("numpy").array([sum(model.weights[f] * x for f, x in known.of(t or "").items())]))[0, -1]
    assert sorted(kept["quality_classifier"], key=str) == sorted(((i, t) for i, t in rows if tail(t) >= quality.KEEP), key=str)
    good = {i for i, _, q in labels if q}
    assert len(good & {i for i, _ in kept["quality_classifier"]}) / len(good) > 0.97

    first = {}
    for i, t in kept["toxicity"]:
        first.setdefault(simhash.simhash((t or "").encode()), []).append(i)
    groups = []
    for p, ids in first.items():
        near = [g for g in groups if any(((p ^ q) & (1 << 64) - 1).bit_count() <= 3 for q in g[0])]
        groups = [g for g in groups if g not in near] + [(sum((g[0] for g in near), [p]), sum((g[1] for g in near), ids))]
    assert sorted(i for i, _ in kept["simhash_near_dedup"]) == sorted(min(ids) for _, ids in groups)

    for i, t in kept["secret_scan"]:
        assert not re.search("[0-9a-f]{16,}", t or "")
    assert [t for i, t in kept["secret_scan"] if i == 302][0].endswith(' [SECRET]"')

    pieces = cp.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in kept["secret_scan"]}
    words = packing.WordTokenizer(packing.default_tokenizer())
    assert sum(r.length for r in pieces) == sum(len(words.ids((t or "").encode())) // 4 + 1 for _, t in kept["secret_scan"])
    assert sorted(map(tuple, cp.run(spark, d).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces)
    assert toxicity.THRESHOLD == 0.7 and secrets.KINDS[0] == "assign"
