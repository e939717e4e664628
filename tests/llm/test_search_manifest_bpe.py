"""The search, the manifest and the automaton against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest

from planweave.llm import bpe, manifest, queries, search

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, stretch string, digest int, part string, leaf long, at string"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars), with further columns of clashing names."""
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 2, "w") for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_merkle_manifest"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    told = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(told) and told


# ---- search

ODD = [
    (1, "the cat", "a", "s", 1), (2, "The CAT the cat", "a", "s", 1), (2, "The CAT the cat", "a", "s", 1), (None, "cat", None, "s", None), (4, None, "a", None, 1), (5, "", "a", "s", 1),
    (6, "été ÉTÉ naïve\x00cat_cat", "a", "s", 1), (7, "dog " * 50_000 + "cat", "b", "s", 1), (8, "!!! ---", "b", "s", 1), (9, "a\x7fb中文 x١", "b", "s", 1),
]


def plain_search(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = [(i, Counter(w), len(w)) for i, w in ((r[0], terms(r[1])) for r in rows)]
    n_docs, words = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    spread = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for place, (doc, c, n) in enumerate(held):
            score = 0
            for t in terms(text):
                if t in c:
                    m = 25 + 75 * n * n_docs // words
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * spread[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, place, doc))
        out += [(item, rank + 1, s[4], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return out


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_search_on_odd_rows(spark, monkeypatch):
    items = [(1, "CAT cat dog"), (2, None), (3, "nothing here"), (4, "été ÉTÉ"), (5, "a b 中文 x١"), (1, "naïve")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    told = sorted(plain_search(ODD, [(1, "CAT cat dog naïve"), *items[1:5]]), key=str)
    rows = docs(spark, ODD).coalesce(1)
    assert found(search.report(rows, asked)) == told
    monkeypatch.setattr(search, "SENT", 0)  # the same where nothing may be sent to all tasks
    assert found(search.report(rows, asked)) == told
    assert search.report(docs(spark, []), asked).count() == 0
    assert search.report(rows, asked.limit(0)).count() == 0


def test_search_over_many_stretches_with_ties(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(random.choices(words, weights=range(60, 0, -1), k=random.randint(0, 30))) for _ in range(400)]
    rows = [(i, texts[i % 400], "a", "s", 1) for i in range(4000)]  # every text ten times: ties go by id
    items = [(i, " ".join(random.choices(words, k=6))) for i in range(12)]
    df = docs(spark, rows).repartition(3)
    assert found(search.report(df, spark.createDataFrame(items, "item_id long, text string"))) == sorted(plain_search(rows, items), key=str)


def test_search_with_ids_of_text_and_all_terms(spark):
    rows = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one")], "doc_id string, text string").coalesce(1)
    lists = search.bucketed(search.postings(rows))
    assert {r.term for r in lists.collect()} == {None, "one", "two"}
    got = search.search(lists, search.asked_terms(spark.createDataFrame([(1, "two")], "item_id long, text string")), 5)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == ["a", "b"]


# ---- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows of (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, more=0: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))

    def tree(leaves):
        ways, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
        while len(level) > 1:
            runs = [level[i : i + arity] for i in range(0, len(level), arity)]
            for i, p in enumerate(at):
                run = runs[p // arity]
                ways[i].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
            level, at = [h(*run) for run in runs], [p // arity for p in at]
        return level[0], ways

    out, tops = [], []
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, ways = tree([leaf(r) for r in own])
        tops.append(subroot)
        out.append((own, ways))
    if not tops:
        return []
    root, over = tree(tops)
    rowsout = []
    for (own, ways), subroot, more in zip(out, tops, over, strict=True):
        for r, way in zip(own, ways, strict=True):
            import zlib

            node = leaf(r, 1 if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0 else 0)
            for before, after in way + more:
                node = h(before, node, after)
            rowsout.append((r[0], leaf(r), subroot, root, h(*(b + a for b, a in way + more)), node, node == root))
    return rowsout


@pytest.mark.parametrize(("arity", "part", "fan", "n"), [(2, 16384, 128, 0), (2, 5, 2, 137), (3, 4, 3, 100), (2, 7, 4, 64), (2, 16384, 128, 1)])
def test_manifest(spark, monkeypatch, arity, part, fan, n):
    random.seed(n)
    rows = [(i * 3, f"text {i}" if i % 5 else None, random.choice(["en", "de", "é", None, "en", "en"]), "s" if i % 4 else None, i if i % 3 else None) for i in range(n)]
    if n > 99:
        rows += [(7, "", "solo", "s", 0), (None, "x" * 100_000, "en", "s", 1), (None, "é中", "en", "s", 1)] + [(9, "same", "en", "s", 4)] * 20
    monkeypatch.setattr(manifest.manifest, "__defaults__", (*manifest.manifest.__defaults__[:4], arity, part, fan))
    got = manifest.report(docs(spark, rows).repartition(3))
    told = plain_manifest(rows, arity)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(told, key=str)
    if n > 99:
        assert {r[-1] for r in told} == {True, False}


def test_forests_merge_in_any_order():
    random.seed(5)
    for n, arity in ((1, 2), (6, 2), (37, 2), (50, 3), (64, 4), (29, 5)):
        leaves, sizes = {(0, i): h(str(i)) for i in range(n)}, manifest.levels(n, arity)
        whole, steps = manifest.merged(leaves, sizes, arity)
        assert list(whole) == [(len(sizes) - 1, 0)] and len(steps) == sum(sizes) - 1
        for _ in range(5):
            parts = [{} for _ in range(4)]
            for key, value in leaves.items():
                random.choice(parts)[key] = value
            forests = [manifest.merged(p, sizes, arity)[0] for p in parts]
            random.shuffle(forests)
            a, _ = manifest.merged(forests[0] | forests[1], sizes, arity)
            b, _ = manifest.merged(forests[2] | forests[3], sizes, arity)
            assert manifest.merged(a | b, sizes, arity)[0] == whole


# ---- tokenization automaton


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.default_tokenizer())
    found.no_truncation()
    found.no_padding()
    return found


def odd_texts(n):
    random.seed(11)
    letters = [*"abcdefghijklmnopqrstuvwxyz ABC 0123456789  \t\n\r.,'!?-_<|>", "é", "中", "\U0001f600", "​", " ", "\x1c", "\x1f", "\x85", "\xa0", "　", "́", "'ll", "'S", "the", "ing", "<|endoftext|>", "٠", "Ⅷ", "\xb2", "\x00", "<|endof"]
    return ["".join(random.choices("abcdeoinst" if i % 3 == 0 else letters, k=random.randint(0, 120))) for i in range(n)]


def test_encodes_and_decodes_as_the_library(library):
    mine = bpe.tokenizer(bpe.default_tokenizer())
    for text in [*odd_texts(3000), "", " ", "\n\n x", "a" * 5000, "ab" * 4000, "<|endoftext|>" * 3, " " * 300, "<|endoftext|> the<|endoftext|>"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids and mine.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for _ in range(300):  # ids that no text has: bytes that aren't UTF-8
        ids = random.choices(range(50257), k=9)
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_accepts_only_what_merging_gives():
    letters, merges = "abc", []
    random.seed(2)
    for _ in range(20):  # random rules over three letters, against merging rule by rule
        vocabulary, merges = list(letters), []
        while len(merges) < 12:
            a, b = random.choices(vocabulary, k=2)
            if a + b not in vocabulary and len(a + b) < 7:
                vocabulary.append(a + b)
                merges.append((a, b))
        at = {v: i for i, v in enumerate(vocabulary)}
        found = bpe.Automaton([v.encode() for v in vocabulary], [(at[a], at[b], at[a + b]) for a, b in merges])
        for _ in range(60):
            word = "".join(random.choices(letters, k=random.randint(1, 14)))
            parts = list(word)
            for a, b in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (a, b):
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert [vocabulary[i] for i in found.path(word.encode())] == parts
            assert found.spelt(found.path(word.encode())).decode() == word


def test_bpe_report(spark, library):
    texts = [*odd_texts(40), None, "", "word " * 60_000, "same", "same"]
    rows = docs(spark, [(None if i == 3 else i // 2, t, "a", "s", 1) for i, t in enumerate(texts)])
    told = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        told.append((None if i == 3 else i // 2, len(ids), h(",".join(map(str, ids))), h(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.report(rows).collect()), key=str) == sorted(told, key=str)
    again = bpe.decoded(bpe.encoded(rows))
    assert sorted(((r.doc_id, r.text) for r in again.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=str)
    assert bpe.report(rows.limit(0)).count() == 0


def test_other_tokenizer_files_are_told(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_merges_that_overlap_go_from_left_to_right():
    found = bpe.Automaton([b"l", b"ll"], [(0, 0, 1)])
    assert [found.path(b"l" * n) for n in range(1, 6)] == [[0], [1], [1, 0], [1, 1], [1, 1, 0]]
