"""Byte-level BPE by a tokenization automaton: its arcs are tokens, and a text's encoding is the one path that spells it.

At first there is one state with an arc to itself for every byte. The merges are added in
order, each by a gadget: for the merge of u and v to w, the arc v is taken from the state
after u, so the two no longer follow each other, and w leads, from wherever u did, to
where v did; the state after w is the one after v as it is then, before later merges take
from it. So a state is told by the token before it, and what `arc` needs to know of
the gadgets are three tables: the merge of a pair, and a token's two parts. Written out whole, the automaton of
50,000 merges would have about as many states and thousands of millions of arcs; a state's
arcs are worked out from the gadgets when they are first asked for and then kept, in a table.

A word is encoded in one pass: at every byte the tokens that end there come from a trie with
failure links, and the one whose start has an arc for it is the last of the prefix's path.
There is exactly one, so nothing is tried twice and long words cost as much a byte as short
ones. Decoding puts the labels of the arcs together again.

Null text counts as empty (no tokens). Repeated rows are encoded as often as they occur, null
ids too; an empty table gives no rows. Columns other than those named don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, whole_text

#: Words whose path a worker keeps, the longest such word in bytes, arcs that are kept, and documents that are decoded together.
CACHE, CACHED_BYTES, ARCS, TOGETHER = 300_000, 64, 2_000_000, 64
# White space, and how the tokenizer takes a text apart.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The byte that each character of the file's tokens stands for: printable Latin-1 is itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """The states after each token, by the gadgets of the merges in their order."""

    def __init__(self, labels: list[bytes | None], merges: Iterable[tuple[int, int, int]]):
        import ahocorasick

        #: Bytes of each arc; of a pair, the token that its gadget made and when; of a token, its parts and when it was made.
        self.labels = labels
        self.parts: list[tuple[int, int] | None] = [None] * len(labels)
        self.made = [-1] * len(labels)
        self.gadget: dict[tuple[int, int], int] = {}
        for rank, (u, v, w) in enumerate(merges):
            self.add(rank, u, v, w)
        self.table: dict[int, bool] = {}
        self.ends = ahocorasick.Automaton()
        for token, label in enumerate(labels):
            if label is not None and self._reached(token):
                self.ends.add_word(label.decode("latin-1"), (len(label), token))
        self.ends.make_automaton()

    def add(self, rank: int, u: int, v: int, w: int) -> None:
        """The gadget of a merge: no arc v after u from now on, and an arc w beside u. A rule whose pair never meets makes none."""
        if self.parts[w]:
            raise ValueError("two rules for one token")
        if not (self._reached(u) and self._reached(v) and self._worked_out(u, v)):
            return
        self.gadget[u, v] = rank
        self.parts[w], self.made[w] = (u, v), rank

    def _reached(self, token: int) -> bool:
        return len(self.labels[token]) == 1 or self.parts[token] is not None

    def arc(self, before: int, token: int) -> bool:
        """Whether the state after `before` has an arc for `token`; `before` -1 is the start."""
        if before < 0:
            return True
        key = before << 32 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= ARCS:
                self.table.clear()
            found = self.table[key] = self._worked_out(before, token)
        return found

    def _worked_out(self, before: int, token: int) -> bool:
        # Back through time: up to `before`'s making its state is that of its right part, up to `token`'s its arc was that of its
        # left part. A rule merges from left to right, so one that made `token` may have met this pair first; one that made `before` has not.
        until = 1 << 62
        while True:
            taken = self.gadget.get((before, token))
            if taken is not None and taken < until:
                return False
            a, b = self.made[before], self.made[token]
            if a < 0 and b < 0:
                return True
            if a >= b:
                before, until = self.parts[before][1], a
            else:
                token, until = self.parts[token][0], min(until, b + 1)

    def path(self, word: bytes) -> list[int]:
        """The tokens on the one path that spells `word`."""
        n = len(word)
        last, came = [-1] * (n + 1), [0] * (n + 1)
        done = 0
        for end, (size, token) in self.ends.iter(word.decode("latin-1")):
            end += 1
            if end > done:
                start = end - size
                if self.arc(last[start], token):
                    last[end], came[end], done = token, start, end
        if done < n:
            raise ValueError("a byte without a token")
        out = []
        while n:
            out.append(last[n])
            n = came[n]
        return out[::-1]

    def spelt(self, tokens: Iterable[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, tokens))


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    """One for all tasks of a worker."""
    return Tokenizer(path)


class Tokenizer:
    """A byte-level BPE file of the tokenizers library, without its library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        model, before = found["model"], found["pre_tokenizer"]
        odd = model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        if odd or found.get("normalizer") or before["type"] != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        byte_of, vocabulary = byte_characters(), model["vocab"]
        added = {t["content"]: t["id"] for t in found.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in found.get("added_tokens", [])):
            raise ValueError("added tokens that take more than themselves")
        labels: list[bytes | None] = [None] * (1 + max([*vocabulary.values(), *added.values()]))
        for piece, i in vocabulary.items():
            labels[i] = bytes(byte_of[c] for c in piece)
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.automaton = Automaton(labels, ((vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges))
        for text, i in added.items():
            labels[i] = text.encode()
        self.added = added
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.words = regex.compile(SPLIT)
        self.known: dict[str, list[int]] = {}

    def _ids_of_part(self, text: str, out: list[int]) -> None:
        known = self.known
        for word in self.words.findall(text):
            ids = known.get(word)
            if ids is None:
                raw = word.encode()
                ids = self.automaton.path(raw)
                if len(raw) <= CACHED_BYTES:
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = ids
            out += ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for mark in self.marks.finditer(text) if self.marks else ():
            self._ids_of_part(text[at : mark.start()], out)
            out.append(self.added[mark.group()])
            at = mark.end()
        self._ids_of_part(text[at:] if at else text, out)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return self.automaton.spelt(ids).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    name = path or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tokenizer(name)
        for batch in text_slices(batches):
            ids = [found.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of `encoded`'s rows."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    name = path or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tokenizer(name)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                texts = [found.decode(i or ()) for i in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: encoded, then decoded from the ids, in one task without a shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    name = path or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tokenizer(name)
        decimal = [str(i) for i in range(len(found.automaton.labels))]
        for batch in text_slices(batches):
            counts, digests, back = [], [], []
            for text in batch.column(1):
                ids = found.encode(text.as_py())
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(found.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
