"""Packing and SimHash near-duplicates against plain Python on small fixtures."""

import random
import zlib

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from planweave.llm import packing, simhash

DOCS = "doc_id bigint, text string, lang string, fp int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], DOCS)


TEXTS = [(1, "Hello WORLD, it's <|endoftext|> 12345 ﬁn é 🙂"), (2, None), (3, ""), (4, "lorem ipsum dolor sit " * 2000), (5, "x" * 20000), (None, "tab\tand\x1fodd\x85white"), (1, "again"), (1, "again")]


def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    expected = []
    for i, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            piece = np.array(ids[k : k + 2048], "<u4").tobytes()
            expected.append((i, k // 2048, k, len(piece) // 4, zlib.crc32(piece)))
    got = packing.report(docs(spark, TEXTS)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, expected)) == sorted(key(r[:5]) for r in got)
    check_gapless(got)


def test_words_alone_equal_whole_texts():
    """Against the tokenizer on whole texts: contractions, signs, digits, controls, other scripts, its special tokens' names."""
    words = packing.WordTokenizer(packing.default_tokenizer())
    rng = random.Random(7)
    bits = ["don't", "we'LL", "x's's", "'", "''s", "a'b", "12ab3", "...", "<|endoftext|>", "a<|startoftext|>b", "<|", "\x1c", "\x00a", "é", "İstanbul", "ﬁn", "e\u0301", "中文", "🙂", "a\u200db", "ſ", "K", "A" * 70, "_a_", "tab", "\x7f"]
    texts = [" ".join("".join(rng.choices(bits, k=rng.randrange(1, 4))) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert words.ends.any()


def check_gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_packing_is_tight(spark):
    rng = random.Random(5)
    rows = [(i, 0, 0, min(2048, int(rng.paretovariate(1.1) * 40)), i) for i in range(3000)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    used = check_gapless(packing.packed(cut, 2).collect())
    assert used <= 1.01 * sum(r[3] for r in rows) / 2048 + 2
    assert packing.report(docs(spark, TEXTS).limit(0)).count() == 0


def test_equal_rows_are_spread(spark):
    from pyspark.sql import functions as F

    rows = spark.range(9000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    groups = packing.packed(packing.pieces(rows), 3).groupBy(F.shiftright("sequence_id", 32)).count().collect()
    assert len(groups) == 3 and max(r["count"] for r in groups) < 4000
    assert check_gapless(packing.report(rows).collect()) <= 9


def test_plain_rule_opens_where_that_is_least():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randrange(1, 33) for _ in range(rng.randrange(1, 60))]
        bins, _ = packing.sum_of_squares(np.array(sizes, np.int64), 32, opening=True)
        fill = {}
        for size, at in zip(sizes, bins, strict=True):
            squares = lambda f: sum(n * n for n in np.bincount([32 - x for x in f if x < 32], minlength=33))
            after = {b: squares([x + size * (k == b) for k, x in fill.items()]) for b, f in fill.items() if f + size <= 32}
            opened = squares([*fill.values(), size])
            assert (after[at] if at in fill else opened) == min([opened, *after.values()])
            assert at in fill or opened < min(after.values(), default=1 << 60)
            fill[at] = fill.get(at, 0) + size


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_sum_of_squares_rule(sizes):
    bins, offsets = packing.sum_of_squares(np.array(sizes, np.int64), 32)
    fill = {}
    for size, at, offset in zip(sizes, bins, offsets, strict=True):
        options = [b for b, f in fill.items() if f + size <= 32]
        squares = lambda f: sum(n * n for n in np.bincount([32 - x for x in f if x < 32], minlength=33))
        if at in fill:
            best = min((squares([x + size * (k == b) for k, x in fill.items()]), 32 - fill[b] - size) for b in options)
            assert best == (squares([x + size * (k == at) for k, x in fill.items()]), 32 - fill[at] - size)
        else:
            assert not options
        assert offset == fill.get(at, 0)
        fill[at] = fill.get(at, 0) + size
        assert fill[at] <= 32


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    texts = [(10, None), (11, " \t "), (12, "Ab"), (13, "aB"), (14, "one two\x1cthree four"), (15, "É É É é"), (16, "long " * 30000)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(400)] = f"v{rng.randrange(9)}"
        texts.append((100 + i, " ".join(words)))
    texts += [(200 + i, " ".join(rng.choice(base) for _ in range(50))) for i in range(20)] + texts[:2]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.report(docs(spark, texts)).collect())
    prints = [brute_print(t) for _, t in texts]
    roots = brute_components(prints)
    expected = sorted((i, f"{p:016x}", min(texts[k][0] for k in range(len(texts)) if roots[k] == r)) for (i, _), p, r in zip(texts, prints, roots, strict=True))
    assert got == expected


def test_links_brute_force(spark):
    rng = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df), "fp", "hub").collect()}
    expected = brute_components(prints)
    for i, p in enumerate(signed):
        assert roots.get(p, p) == min(q for k, q in enumerate(signed) if expected[k] == expected[i])


def test_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (91, 90)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 91: 90}


def test_first_of_each(spark):
    rows = docs(spark, [(5, "a b c d"), (3, "A B C D"), (3, "A B C D"), (9, "other words entirely here"), (None, "null one"), (None, "null one"), (None, "a b c d")])
    kept = simhash.first_of_each(rows)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "null one"), (3, "A B C D"), (9, "other words entirely here")]
    assert kept.columns == rows.columns
    assert simhash.first_of_each(rows.limit(0)).count() == 0


def test_first_of_each_keeps_clashing_columns(spark):
    rows = [(1, "a b c d", "n", 7), (2, "a b c d", "n2", 8), (3, "quite another text here", "m", 9), (3, "a different one", "m", 10), (None, "a b c d", "x", 11), (None, "lonely words of no id", "y", 12), (None, "lonely words of no id", "z", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _nth string, key int").withColumnRenamed("key", "_key")
    got = sorted(map(tuple, simhash.first_of_each(df).collect()), key=str)
    assert [r[:2] for r in got if r[0]] == [(1, "a b c d"), (3, "a different one")] and [r for r in got if r[0] == 1] == [(1, "a b c d", "n", 7)]
    assert [r[1] for r in got if r[0] is None] == ["lonely words of no id"] and len(got) == 3
    assert simhash.first_of_each(df).columns == df.columns


def test_words_share_their_beginnings_and_letters_go_by_their_bytes(monkeypatch):
    tool, learnt, by_parts = packing.WordTokenizer(packing.default_tokenizer()), [], []
    monkeypatch.setattr(tool, "learn", lambda words, learn=tool.learn: learnt.extend(words) or learn(words))
    monkeypatch.setattr(tool, "told_apart", lambda t, words, *how, through=tool.told_apart: (t is tool.tokenizer and by_parts.extend(words)) or through(t, words, *how))
    long = "é" * 60 + "!"
    text = f"Größe Größe. Größe,! GRÖSSE zungä. don't. don't it's.'s x×. ÷. ã÷! İ. aİ, ſ. <|endoftext|>. a<|endoftext|>b.. a… b…. '' é'. {long} 7. ß-_-"
    assert np.array_equal(np.frombuffer(tool.ids(text.encode()), "<u4"), tool.tokenizer.encode(text, add_special_tokens=False).ids)
    assert learnt.count("Größe".encode()) == 1 and not {"Größe.".encode(), "Größe,!".encode(), "zungä.".encode()} & set(learnt)
    assert not {"Größe".encode(), "GRÖSSE".encode()} & set(by_parts)
    assert long.encode() not in tool.known and long[:-1].encode() not in tool.known and "Größe.".encode() in tool.known
