"""The two classifiers: held-out accuracy on synthetic bags, gradients by their effect, odd rows."""

import random

import numpy as np

from planweave.llm import quality, toxicity

DOCS = "doc_id long, text string, score string, toxic string, quality string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS)


def prose(rng, n):
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame", "con") for b in ("em", "um", "or", "at", "ur", "is")]
    return " ".join(" ".join(rng.choice(words) for _ in range(8)).capitalize() + "." for _ in range(n))


def corpus(n=600):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        text, toxic, junk = prose(rng, rng.randrange(1, 30)), i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(text))
                text = text[:at].rpartition(" ")[0] + " " + rng.choice(["snarf", "glorb", "vexatious"]) + " " + text[at:].partition(" ")[2]
        if junk:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text))
        labels.append((i, int(toxic), int(not junk)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    said = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.report(docs(spark, rows), said.select("doc_id", "toxic")).collect()}
    held = [(got[i], t) for i, t, _ in labels if got[i].held_out]
    assert 150 < len(held) < 250 and all(r.predicted == (r.score >= 0.7) for r, _ in held)
    assert sum(r.predicted == t for r, t in held) / len(held) >= 0.95
    texts = dict(rows)
    spans = [(texts[i][s.start : s.end]) for i, r in got.items() if r.predicted for s in r.offending]
    assert spans and sum(any(w in s.lower() for w in ("snarf", "glorb", "vexatious")) for s in spans) / len(spans) > 0.9


def test_toxicity_odd_rows(spark):
    rows, labels = corpus(60)
    said = spark.createDataFrame([(i, t) for i, t, _ in labels] + [(3, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    odd = docs(spark, rows + [(3, "twice"), (900, None), (901, ""), (None, "no id"), (902, "word. " * 50000), (903, "?!.")])
    out = toxicity.report(odd, said)
    got = out.filter("doc_id >= 900 or doc_id is null").collect()
    assert out.count() == 66 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (900, 901, 903)} == {0.0}
    assert toxicity.report(odd.limit(0), said).count() == 0
    assert toxicity.report(odd, said.limit(0)).filter("score > 0").count() == 0


def test_sample_is_bounded(spark):
    said = spark.createDataFrame([(i, i % 10 == 0) for i in range(20000)], "doc_id long, toxic boolean").withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["col"]).col("toxic").cast("int"))
    counts = {r[0]: r[1] for r in toxicity.sampled(said, "toxic", 1000).groupBy("toxic").count().collect()}
    assert 850 < counts[0] < 1150 and 850 < counts[1] < 1150


def test_quality_held_out(spark):
    rows, labels = corpus()
    said = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in quality.report(docs(spark, rows), said.select("doc_id", "quality")).collect()}
    held = [(got[i], q) for i, _, q in labels if got[i].held_out]
    assert sum(r.keep == q for r, q in held) / len(held) >= 0.97


def test_ordinal_grades_in_order():
    rng, texts, ratings = random.Random(4), [], []
    for _ in range(900):
        share = rng.random()
        texts.append(" ".join("good" if rng.random() < share else "bad" for _ in range(60)))
        ratings.append([1, 3, 4, 9][min(3, int(share * 4))])
    model = quality.train(texts[:600], ratings[:600])
    assert model.grades == [1, 3, 4, 9] and (np.diff(model.thresholds) > 0).all()
    known = quality.Features()
    scores = np.array([sum(model.weights[f] * x for f, x in known.of(t).items()) for t in texts[600:]])
    tails, expected = model.tails(scores), model.expected(scores)
    assert (np.diff(tails, axis=1) <= 0).all() and expected.min() >= 1 and expected.max() <= 9
    assert np.mean([(e >= 3.5) == (r >= 4) for e, r in zip(expected, ratings[600:], strict=True)]) > 0.85


def test_quality_odd_rows(spark):
    said = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], "doc_id long, quality int")
    odd = docs(spark, [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x"), (4, "y " * 90000)])
    out = quality.report(odd, said).collect()
    assert len(out) == 6 and {r.keep for r in out} == {1} and {r.expected_grade for r in out} == {1.0}
    assert quality.report(odd.limit(0), said).count() == 0
    assert quality.report(odd, said.limit(0)).count() == 6


def test_texts_without_words():
    assert toxicity.Scorer(toxicity.train(["", "?!"], [0, 1])).document("a b.")[0] == 0.0
    assert quality.train(["", ""], [0, 1]).tails(np.zeros(1)).shape == (1, 1)


def unsure(n=3000):
    """Every tenth document is of the rare class; of texts with "maybe" every third is."""
    rng, rows = random.Random(9), []
    for i in range(n):
        rare = i % 10 == 0
        word = "maybe" if rng.random() < (0.9 if rare else 0.2) else "surely"
        rows.append((i, f"{word} {prose(rng, 1)}", int(rare)))
    return rows


def test_sampling_keeps_the_shares(spark):
    rows = unsure()
    texts = docs(spark, [(i, t) for i, t, _ in rows])
    # labels without a document, nearly all of the rare class, count for nothing
    labels = spark.createDataFrame([(i, c) for i, _, c in rows] + [(i, 1) for i in range(10000, 19000)], "doc_id long, quality int")
    _, found, weights = toxicity.labelled_texts(texts, labels, "quality", 300)
    totals = np.bincount(found, weights)
    assert found.count(1) == 300 and 240 < found.count(0) < 360
    assert totals[1] == 300 and abs(totals[0] / 2700 - 1) < 0.2

    known = quality.Features()

    def mean_tail(model):
        return model.tails(np.array([sum(model.weights[f] * x for f, x in known.of(t).items()) for _, t, _ in rows])).mean()

    whole = quality.train([t for _, t, _ in rows], [c for *_, c in rows])
    part = quality.train(*toxicity.labelled_texts(texts, labels, "quality", 300))
    assert abs(mean_tail(whole) - 0.1) < 0.03 and abs(mean_tail(part) - 0.1) < 0.03

    score = lambda w: np.mean([toxicity.Scorer(w).document(t)[0] for _, t, _ in rows])
    whole = toxicity.train([t for _, t, _ in rows], [c for *_, c in rows])
    part = toxicity.train(*toxicity.labelled_texts(texts, labels, "quality", 300))
    assert abs(score(part) - score(whole)) < 0.05


def test_fit_is_bounded_in_rows_and_bytes(spark):
    """A labelled id that occurs very often gives one row, long texts at most their budget, and the weights keep the classes' totals."""
    rows = [(1, f"copy {i}") for i in range(5000)] + [(i, "word " * 400) for i in range(2, 400)] + [(400, "x" * (toxicity.LONGEST + 1))]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 401)], "doc_id long, toxic int")
    texts, found, weights = toxicity.labelled_texts(docs(spark, rows), labels, "toxic")
    assert len(texts) == 399 and texts.count("copy 0") == 1 and max(map(len, texts)) == 2000 and set(weights) == {1.0}
    texts, found, weights = toxicity.labelled_texts(docs(spark, rows), labels, "toxic", bytes_most=100_000)
    assert sum(map(len, texts)) <= 100_000 and 20 <= found.count(1) <= 25 and 20 <= found.count(0) <= 26
    totals = np.bincount(found, weights)
    assert abs(totals[0] - 300) < 1e-6 and abs(totals[1] - 99) < 1e-6
    texts, found, _ = toxicity.labelled_texts(docs(spark, rows), labels, "toxic", bytes_most=1)
    assert len(texts) == 2 and set(found) == {0, 1}


def test_noisy_or_brute_force(spark):
    """Scores and spans by a plain version of the noisy-or, over a model trained by the plain gradient too."""
    import math
    import re
    import zlib

    rows, labels = corpus(90)
    toxic = [t for _, t, _ in labels]
    weights = toxicity.train([t for _, t in rows], toxic)

    def plain_features(word):
        return [zlib.crc32(x.encode()) % toxicity.BUCKETS for x in ["w" + word] + ["p" + word[:n] for n in (4, 5) if len(word) > n]]

    def plain(text):
        clean, spans = 1.0, []
        for m in re.finditer(r"[^.!?\n]+", text):
            words = set(re.findall(r"[^\W\d_]+", m[0].lower()))
            p = 1 / (1 + math.exp(-(weights[-1] + sum(weights[f] for w in words for f in plain_features(w)))))
            clean *= 1 - p
            if p >= 0.5:
                spans.append((m.start(), m.end(), p))
        return 1 - clean, spans

    got = {r.doc_id: r for r in toxicity.scored(docs(spark, rows), weights).collect()}
    for i, text in rows:
        score, spans = plain(text)
        assert abs(got[i].score - score) < 1e-9 and [(s.start, s.end) for s in got[i].offending] == [s[:2] for s in spans]
        assert all(abs(s.score - p) < 1e-9 for s, (*_, p) in zip(got[i].offending, spans, strict=True))
    loss = lambda w: -np.mean([math.log(max(1e-12, s if t else 1 - s)) for s, t in ((toxicity.Scorer(w).document(x)[0], t) for (_, x), t in zip(rows, toxic, strict=True))])
    start = np.zeros_like(weights)
    start[-1] = toxicity.BIAS
    assert loss(weights) < 0.5 * loss(start)


def test_cumulative_links_brute_force(spark):
    """Grades' chances by a plain version of features, links and expectation."""
    import math
    import re
    import zlib
    from collections import Counter

    rng, texts, ratings = random.Random(11), [], []
    for _ in range(400):
        share = rng.random()
        texts.append(" ".join(rng.choice(["Good", "fine!!", "x2"]) if rng.random() < share else rng.choice(["BAD", "99,5", "the the"]) for _ in range(rng.randrange(1, 40))))
        ratings.append([0, 2, 5][min(2, int(share * 3))])
    model = quality.train(texts, ratings)

    def shape(word):
        word = re.sub(r"([^\w\s])\1+", r"\1\1", word)
        word = re.sub(r"[^\W\d_a-zà-öø-ÿß]{2,}", "A", word)
        word = re.sub(r"[^\W\d_A-ZÀ-ÖØ-Þ]{2,}", "a", word)
        return re.sub(r"\d+", "0", word)[:12]

    def plain(text):
        words = text.split()
        names = [f"w{w.lower()}" for w in words] + [f"s{shape(w)}" for w in words] + [f"n{shape(a)} {shape(b)}" for a, b in zip(words, words[1:], strict=False)] + ["again" for a, b in zip(words, words[1:], strict=False) if a == b]
        counts = Counter(zlib.crc32(n.encode()) % quality.BUCKETS for n in names)
        score = sum(model.weights[f] * math.sqrt(n / max(1, len(words))) for f, n in counts.items())
        above = [1.0] + [1 / (1 + math.exp(t - score)) for t in model.thresholds] + [0.0]
        return above[1:-1], sum(g * (a - b) for g, a, b in zip(model.grades, above, above[1:], strict=False))

    rows = list(enumerate([*texts, "", "unseen Words 17"]))
    got = {r.doc_id: r for r in quality.scored(docs(spark, rows), model).collect()}
    for i, text in rows:
        tails, expected = plain(text)
        assert np.allclose(got[i].tails, tails, atol=1e-9) and abs(got[i].expected_grade - expected) < 1e-9
