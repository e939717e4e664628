"""Encoding against the library and brute force, decoding as a round trip."""

import itertools
import zlib

import numpy as np

from planweave.llm import pieces

DOCS = "doc_id long, text string, ids string"
TEXTS = [(1, "hello  world"), (2, None), (3, ""), (4, " lead and tail "), (5, "x\ny\t\x00z é🙂中文 ﬁ"), (6, "a▁b"), (7, "word " * 40000), (None, "q" * 3000), (7, "again"), (7, "again"), (8, "don't STOP!!! 1234567890\r\n\n  indented"), (9, " "), (10, "aaaaaaaaaaaaaaaaaaa   bbbbbbb"), (11, "\n"), (12, "\n a\n▁\nb")]


def test_equals_the_library_and_round_trips(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.default_model())
    df = spark.createDataFrame([(i, t, "clash") for i, t in TEXTS], DOCS)
    key = lambda r: tuple(map(str, r))
    expected = sorted(key((i, len(ids := model.encode(t or "")), zlib.crc32(np.array(ids, "<u4").tobytes()))) for i, t in TEXTS)
    got = pieces.report(df).collect()
    assert sorted(key(r[:3]) for r in got) == expected
    assert all(r.round_trip for r in got)
    back = pieces.decoded(pieces.encoded(df)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((i, (t or "").replace("▁", " "))) for i, t in TEXTS)
    assert pieces.report(df.limit(0)).count() == 0


def test_long_words_merge_as_short_ones():
    import random
    import time

    from sentencepiece import SentencePieceProcessor

    merger, model = pieces.Merger(pieces.piece_rows(pieces.default_model())), SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(4)
    words = ["".join(rng.choices(letters, k=rng.randrange(2, 300))) for letters in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz0123456789", "中文字漢éa") for _ in range(60)]
    merged = pieces.Merger.merged_long
    for word in words:
        short = word[: pieces.SHORT]
        assert merged(merger, short) == merger.merged(short) and merged(merger, word) == merger.merged(word)
        assert np.frombuffer(merger.encode(word), "<u4").tolist() == model.encode(word)
    began = time.perf_counter()
    merger.encode("".join(rng.choices("etaoinshrdlu", k=200_000)))
    assert time.perf_counter() - began < 5


def plain_paths(word, table, longest, unknown, least):
    """Score of the best path, position by position."""
    best = [0.0] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [best[start] + (table[word[start:end]][1] if word[start:end] in table else least) for start in range(max(0, end - longest), end) if word[start:end] in table or end - start == 1]
        best[end] = max(options)
    return best[-1]


def test_lattice_of_long_words_and_texts(spark):
    import random

    rng = random.Random(9)
    rows = [(p, i, -float(np.log(i + 1)), kind) for p, i, _, kind in pieces.piece_rows(pieces.default_model())]
    table = {p: (i, s) for p, i, s, kind in rows if kind == "piece"}
    longest, least = max(map(len, table)), min(s for _, s in table.values()) - 10
    long = "".join(rng.choices("etaoinshr", k=30_000))
    docs = spark.createDataFrame([(1, f"the quick brown {long} fox"), (2, None), (3, ""), (4, "the \u0001🙂 the"), (4, "the end")], "doc_id long, text string")
    got = {r.word: r for r in pieces.word_paths(docs, pieces.unigram_table(spark)).collect()}
    assert {w: r.n for w, r in got.items()} == {"▁the": 4, "▁quick": 1, "▁brown": 1, "▁" + long: 1, "▁fox": 1, "▁\u0001🙂": 1, "▁end": 1}
    texts = {i: p for p, (i, _) in table.items()}
    for word, r in got.items():
        scores = [table[texts[i]][1] if i in texts else least for i in r.ids]
        assert abs(sum(scores) - plain_paths(word, table, longest, 0, least)) < 1e-6
        assert sum(len(texts.get(i, "?")) for i in r.ids) == len(word) and all(p in ("?", word[at : at + len(p)]) for p, at in zip([texts.get(i, "?") for i in r.ids], np.cumsum([0] + [len(texts.get(i, "?")) for i in r.ids]).tolist(), strict=False))
    assert pieces.word_paths(docs.limit(0), pieces.unigram_table(spark)).count() == 0


def test_lattice_is_the_best_path(spark):
    table = [("a", 1, -2.0), ("b", 2, -2.5), ("ab", 3, -3.0), ("ba", 4, -3.4), ("aba", 5, -6.0), ("▁", 6, -1.0), ("▁ab", 7, -3.9), ("bb", 8, -6.0)]
    rows = [(p, i, s, "piece") for p, i, s in table]
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("ab▁", repeat=n)][::7] + ["azb", "zz", "", "aab"]
    got = {r.word: list(r.ids) for r in pieces.lattice_encode(spark.createDataFrame([(w,) for w in words] + [("aab",)], "word string"), spark.createDataFrame(rows, "piece string, id int, score double, kind string"), 3).collect()}
    score = {i: s for _, i, s in table} | {0: -16.0}
    ids = {p: i for p, i, _ in table}

    def best(word):
        if not word:
            return 0.0
        return max(best(word[n:]) + score[ids.get(word[:n], 0)] for n in range(1, min(3, len(word)) + 1) if word[:n] in ids or n == 1)

    assert set(got) == {w for w in words if w}
    for word, found in got.items():
        assert abs(sum(score[i] for i in found) - best(word)) < 1e-9
        texts = {i: p for p, i, _ in table}
        assert len("".join(texts.get(i, "?") for i in found)) == len(word)


def test_only_edges_of_the_lattice_are_shuffled(spark):
    words = spark.createDataFrame([("▁ab",), ("b",)], "word string")
    table = spark.createDataFrame([("a", 1, -1.0, "piece"), ("ab", 2, -1.5, "piece")], "piece string, id int, score double, kind string")
    found = pieces.lattice_encode(words, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(piece" not in plan and "BroadcastHashJoin [piece" in plan
    assert dict(map(tuple, found.collect())) == {"▁ab": [0, 2], "b": [0]}
