"""The language model: counts against brute force, normalisation, held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from planweave.llm import lm

DOCS = "doc_id long, text string, word string, key int"


def corpus():
    rng = random.Random(6)
    langs = [[f"{p}{i}" for i in range(300)] for p in ("ka", "zu", "mi", "to")]
    rows = []
    for i in range(400):
        words = rng.choice(langs)
        rows.append((i, " ".join(words[min(299, int(rng.paretovariate(0.7)))] for _ in range(rng.randrange(1, 200)))))
    return rows + [(1000, None), (1001, ""), (None, "ka1 NEVER seen É"), (1003, "KA1 ka2\x0bka3 " * 20000), (7, "twice"), (7, "twice")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], DOCS)
    split = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    toks = [lm.tokens((t or "").encode()) for _, t in rows]
    counts = Counter(w for (i, _), t in zip(rows, toks, strict=True) if split(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6))
    score = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    expected = sorted(key((i, len(t), sum(counts[w] > 0 for w in t), score(t))) for (i, _), t in zip(rows, toks, strict=True))
    for hot in (lm.HOT, 40):
        got = lm.report(df, hot=hot).collect()
        assert {r.train_tokens for r in got} == {n}
        for a, b in zip(sorted(key((r.doc_id, r.n_tokens, r.n_known, r.base_score)) for r in got), expected, strict=True):
            assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4
        held = [r for r in got if r.held_out]
        assert all(r.held_out == (split(r.doc_id) == 0) for r in got) and all(math.isfinite(r.score) and r.score < 0 for r in got)
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.report(df.limit(0)).count() == 0


def test_buckets_agree(spark):
    from pyspark.sql import functions as F

    words = [b"a", b"ab", b"abc", b"abcd", "né".encode(), b"\xff\xff\xff", b"zz|"]
    got = {bytes(r.w): r.b for r in spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select("w", lm.bucket_column(F.col("w")).alias("b")).collect()}
    assert [got[w] for w in words] == [lm.bucket_of(w) for w in words] == lm.buckets_of(words).tolist()
    assert max(got.values()) < lm.BUCKETS and len(lm.buckets_of([])) == 0


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    flat = lm.initial(np.full(lm.OUTPUTS, 1 / lm.OUTPUTS)) + rng.normal(0, 0.5, sum(int(np.prod(s)) for s in lm.SHAPES)).astype(np.float32)
    total = 0.0
    for w in range(lm.OUTPUTS):
        outputs = np.array([3, 4, 5, 6, 7, w])
        total += 10 ** lm.log_probabilities(flat, outputs, np.arange(6) == 0)[-1]
    assert abs(total - 1) < 1e-4
    apart = lm.log_probabilities(flat, np.array([3, 4, 9]), np.array([True, False, True]))
    assert abs(apart[2] - lm.log_probabilities(flat, np.array([9]), np.array([True]))[0]) < 1e-6


def test_runs_hold_every_token_once_as_target():
    """Runs of any length have the targets and the contexts of single windows; what is no token is no target."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 50, 40)
    outputs = rng.integers(0, lm.OUTPUTS, sizes.sum())
    single = sorted(map(tuple, lm.windows_of(outputs, sizes).tolist()))
    for run in (2, 7, lm.RUN):
        rows = lm.windows_of(outputs, sizes, run)
        cut = [tuple(r[i : i + lm.CONTEXT + 1]) for r in rows.tolist() for i in range(run) if r[i + lm.CONTEXT] < lm.OUTPUTS]
        assert sorted(cut) == single and len(cut) == sizes.sum()


def test_runs_give_the_gradient_of_their_windows():
    rng = np.random.default_rng(4)
    frequency = np.full(lm.OUTPUTS, 1 / lm.OUTPUTS)
    start = lm.initial(frequency) + rng.normal(0, 0.3, len(lm.initial(frequency))).astype(np.float32)
    sizes = rng.integers(1, 60, 30)
    outputs = rng.integers(0, lm.OUTPUTS, sizes.sum())
    ends = []
    for run in (1, 5, lm.RUN):
        trainer = lm.Trainer(start, frequency, 1)
        trainer.fit(lm.windows_of(outputs, sizes, run))
        assert trainer.targets == sizes.sum()
        ends.append(trainer.flat)
    assert np.allclose(ends[0], ends[1], atol=1e-4) and np.allclose(ends[0], ends[2], atol=1e-4)


def test_every_token_is_a_target():
    texts = [np.array([*range(10 * i, 10 * i + n - 1), 300]) for i, n in enumerate((1, 2, 3, 4, 5, 6, 9, 23))]
    got = sorted(map(tuple, lm.windows_of(np.concatenate(texts), np.array([len(t) for t in texts])).tolist()))
    padded = [[lm.OUTPUTS] * lm.CONTEXT + t.tolist() for t in texts]
    assert got == sorted(tuple(p[i : i + lm.CONTEXT + 1]) for p in padded for i in range(len(p) - lm.CONTEXT))


def test_short_texts_and_ends_train(spark):
    docs = spark.createDataFrame([(i, t) for i in range(40) for t in ("", None, "aa", "aa bb", "aa bb cc")], "doc_id long, text string")
    words = lm.vocabulary(lm.word_counts(docs))
    before, after = lm.initial(words.frequency), lm.trained(docs.repartition(1), words)
    end = words.outputs[lm.END]
    shift = lm.unpacked(after)[3] - lm.unpacked(before)[3]
    assert end == 0 and shift[end] > 0
    rows = [[end], [words.outputs[b"aa"], end]]
    for r in rows:
        begins = np.arange(len(r)) == 0
        assert lm.log_probabilities(after, np.array(r), begins)[-1] > lm.log_probabilities(before, np.array(r), begins)[-1]


def test_gradient_descends():
    rng = np.random.default_rng(3)
    frequency = np.full(lm.OUTPUTS, 1 / lm.OUTPUTS)
    trainer = lm.Trainer(lm.initial(frequency), frequency, 1)
    before = rng.integers(0, 8, (4096, lm.CONTEXT))
    windows = np.column_stack([before, before[:, -1] + 10])
    for _ in range(150):
        trainer.fit(windows)
    last = lm.log_probabilities(trainer.flat, np.array([1, 2, 3, 4, 14]), np.arange(5) == 0)[-1]
    assert last > np.log10(0.5)


def test_held_out_gain_on_the_given_documents(spark):
    """Over the base, per held-out token, in log10; and each token is a target in every pass."""
    from planweave.llm import queries

    got = queries.queries()["op7_language_model"](spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert (got.s - got.b) / got.n > 0.08
    assert lm.PASSES >= 2


def test_long_words_are_not_sent_to_all(spark):
    docs = spark.createDataFrame([(i, "x" * 5000 + " ab ab") for i in range(50)], "doc_id long, text string")
    words = lm.vocabulary(lm.word_counts(docs))
    assert set(words.hot) == {b"ab", lm.END} and words.total == 200 and words.distinct == 3
    got = lm.report(docs, parts=10).collect()
    assert all(r.n_tokens == 4 and r.n_known == 4 and r.score < 0 for r in got)


def test_gradient_is_that_of_the_loss():
    """By differences of the loss, with the noise words that the step drew."""
    rng = np.random.default_rng(5)
    frequency = rng.random(lm.OUTPUTS)
    frequency /= frequency.sum()
    flat = (lm.initial(frequency) + rng.normal(0, 0.3, len(lm.initial(frequency)))).astype(np.float32)
    windows = rng.integers(0, lm.OUTPUTS, (7, lm.CONTEXT + 1))
    noise = np.random.default_rng([lm.SEED, 1]).choice(lm.OUTPUTS, lm.NOISE, p=frequency)

    def loss(flat):
        context, places, vectors, biases = lm.unpacked(flat.astype(float))
        total = 0.0
        for *before, target in windows.tolist():
            predicted = sum(context[w] * places[i] for i, w in enumerate(before))
            delta = lambda w, predicted=predicted: predicted @ vectors[w] + biases[w] - math.log(lm.NOISE_EACH * frequency[w])
            total += math.log1p(math.exp(-delta(target))) + sum(math.log1p(math.exp(delta(w))) for w in noise) * lm.NOISE_EACH / lm.NOISE
        return total / len(windows)

    trainer = lm.Trainer(flat, frequency, 1)
    trainer.second[:] = 1e12  # steps so small that the gradient can be read off
    before = trainer.flat.astype(float)
    trainer.flat = before.copy()
    trainer.fit(windows)
    gradient = (before - trainer.flat) * 1e6 / lm.STEP
    shaken = np.concatenate([np.flatnonzero(np.abs(gradient) > 1e-3)[::17], [0, 5000]])
    for i in shaken:
        up, low = before.copy(), before.copy()
        up[i], low[i] = up[i] + 1e-4, low[i] - 1e-4
        assert abs((loss(up) - loss(low)) / 2e-4 - gradient[i]) < 2e-3, i
