"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document is its token ids and a closing id 0. Documents longer than a sequence are
cut into pieces of a sequence's length; the last piece may be shorter. Every piece
is placed in the open sequence after which the sum, over all residual gaps, of the
squared number of open sequences with that gap becomes smallest (ties: the smallest
gap left); a new one is opened only when it fits in none, or, with `opening`, as the
plain rule has it, wherever that makes the sum smallest. Pieces are dealt out by hash,
of their place in their task too, to groups of about GROUP and each group is packed by
itself, longest first, so the number of groups grows with the input, equal rows don't
meet in one, and a group's state is one count per gap.

Null text counts as empty (one id, the closing 0). Repeated rows are packed as often
as they occur, null ids too; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, whole_text

LENGTH = 2048
CLOSING = 0
#: Pieces of a group, and bytes that a token has at least on average (only the number of groups depends on it).
GROUP, TOKEN_BYTES = 4096, 2
#: Words whose ids a worker keeps (or as many as a slice of texts has), and the longest such word in bytes.
CACHE, CACHED_BYTES = 400_000, 64
#: Words that are encoded together.
TOGETHER = 1000
# The parts that the tokenizer takes a word for, of words without other than ASCII and Latin letters
# (but for the two that lower to several characters, or to another's case).
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e\u0180-\u024f"
PLAIN = re.compile(f"[\x00-\x7f{LATIN}]+")
LETTERS = re.compile(f"[{LATIN}]+")
PARTS = re.compile(f"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[{LATIN}]+|[0-9]|[^\\s{LATIN}0-9]+")

# What may follow a word's last letter as a part of its own, whatever the word is (no apostrophes, nor what special tokens are written with), and a last letter that is one in lower case, too.
TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
ENDS = re.compile(rb"(?:[A-Za-z]|(?!\xc3[\x97\xb7]|\xc4\xb0)[\xc3-\xc8][\x80-\xbf])\Z")
#: The character that stands for each byte, its own or one from 256 on (a space parts words here).
LEVEL = np.arange(256, dtype="<u2")
LEVEL[[*range(33), *range(127, 161), 173]] = np.arange(256, 256 + 33 + 34 + 1)
LEVEL[32] = 32


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a worker."""
    return WordTokenizer(path)


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, word by word: equal words are encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        found = json.loads(self.tokenizer.to_str())
        kinds = lambda of, parts: [x["type"] for x in (found.get(of) or {}).get(parts, [])]
        suffix, vocabulary = found["model"].get("end_of_word_suffix"), found["model"]["vocab"]
        #: Marks of the ids that end a part of a word; none if the vocabulary doesn't tell.
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        if suffix:
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        #: For lower-case letters, whose bytes are all that the full one's first steps still change.
        self.bare, self.tails = None, False
        if suffix and kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]:
            self.bare = Tokenizer.from_str(self.tokenizer.to_str())
            self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            #: Whether a word and what follows its last letter can be encoded apart.
            self.tails = all(len(split("a" + tail)) == 2 for tail in (TAIL.decode(), *TAIL.decode()))

    def learn(self, words: list[bytes]) -> None:
        """Keep each word's ids. The parts of words of ASCII and Latin letters can be counted, so their ids are told apart by the parts' ends; of others tokens' offsets are needed."""
        letters = [w for w in words if w.isalpha() or LETTERS.fullmatch(w.decode("utf-8", "replace"))] if self.bare else []
        if letters:
            text = b" ".join(letters).decode().lower()
            text = text if text.isascii() else LEVEL[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
            self.told_apart(self.bare, letters, text, np.arange(len(letters)))
            words = list(set(words).difference(letters))
        simple, texts, others = [], [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            if PLAIN.fullmatch(text) and "<|" not in text:
                simple.append(w)
                texts.append(text)
            else:
                others.append(w)
        if simple:
            self.told_apart(self.tokenizer, simple, " ".join(texts), np.cumsum([len(found) for found in map(PARTS.findall, texts)]) - 1)
        if others:
            self.by_offsets(others)

    def told_apart(self, tokenizer, words: list[bytes], text: str, last: np.ndarray) -> None:
        """`last`: the place of each word's last part among all parts."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        after = np.flatnonzero(self.ends[ids]) + 1
        if len(after) == last[-1] + 1:
            self.keep(words, ids, after[last])
        else:  # a tokenizer of other parts than these
            self.by_offsets(words)

    def by_offsets(self, words: list[bytes]) -> None:
        """The words go in as one text and the tokens' offsets tell whose they are."""
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids, begins = np.array(found.ids, "<u4"), np.array([a for a, _ in found.offsets], np.int64)
        self.keep(words, ids, np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts])))

    def keep(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        whole, at = ids.tobytes(), (4 * ends).tolist()
        self.known.update(zip(words, [whole[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)], strict=True))

    def ids(self, text: bytes) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids. ASCII white space parts words in any text, so each can be encoded alone."""
        known, words = self.known, [t.split() for t in texts]
        missing = set().union(*words).difference(known)
        if len(known) + len(missing) > CACHE:
            known.clear()
            missing = set().union(*words)
        apart = self.apart(missing) if self.tails else {}
        new = list(missing.difference(apart).union(*apart.values()).difference(known))
        for i in range(0, len(new), TOGETHER):
            self.learn(new[i : i + TOGETHER])
        known.update([(w, known[a] + known[b]) for w, (a, b) in apart.items()])
        out = [b"".join(map(known.__getitem__, of)) for of in words]
        for w in (*missing, *new):
            if len(w) > CACHED_BYTES:
                known.pop(w, None)
        return out

    def apart(self, words: Iterable[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """The words that end in other than letters and digits, each up to its last letter and from there on: words with equal beginnings share its ids."""
        cut = ((w, w.rstrip(TAIL)) for w in words)
        return {w: (begin, w[len(begin) :]) for w, begin in cut if len(begin) < len(w) and ENDS.search(begin, max(0, len(begin) - 2))}


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document, and its place among all pieces (any number of its own)."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, closing = word_tokenizer(path), np.array([CLOSING], "<u4").tobytes()
        place = TaskContext.get().partitionId() << 40
        for batch in text_slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.ids_of(batch.column(1).to_pylist()), strict=True):
                ids += closing
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    piece = ids[at : at + 4 * length]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            columns = [*zip(*rows, strict=True), range(place, place + len(rows))]
            place += len(rows)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "place"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().cast("binary").alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, place long")


def sum_of_squares(sizes: np.ndarray, length: int, opening: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item, placed in the given order; with `opening`, a new bin is one of the choices even where an open one fits."""
    open_by_gap: list[list[int]] = [[] for _ in range(length + 1)]
    count = np.zeros(length + 1, np.int64)
    bins, offsets, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes):
        # an open bin of gap g becomes one of gap g - size: the squares change by (1 - 2 n[g]) + (1 + 2 n[g - size]), or less the latter if full
        change = np.where(count[size:length] > 0, 2 * (count[: length - size] - count[size:length]) + 2, 1 << 62)
        if size < length and count[size]:
            change[0] -= 1 + 2 * count[0]
        best = int(change.argmin()) if size < length else -1
        fits = best >= 0 and change[best] < 1 << 61
        if fits and not (opening and 1 + 2 * count[length - size] < change[best]):
            gap = best + size
            at = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, at, used = length, used, used + 1
        left = gap - size
        bins[i], offsets[i] = at, length - gap
        if left:
            open_by_gap[left].append(at)
            count[left] += 1
    return bins, offsets


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def packed(cut: DataFrame, groups: int, length: int = LENGTH, opening: bool = False) -> DataFrame:
    """`cut` with sequence_id and offset; about `groups` groups are packed on their own. Without a place, pieces are dealt out by what they are."""
    own = ["place"] if "place" in cut.columns else ["doc_id", "piece", "ids_crc32"]

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *own], ascending=[False] + [True] * len(own), kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), length, opening)
        return rows[COLUMNS].assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    kind = cut.schema["doc_id"].dataType.simpleString()
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(*own), F.lit(max(1, groups))))
    return dealt.groupBy("_group").applyInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def report(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, opening: bool = False) -> DataFrame:
    # about as many pieces as there are documents, and one more for every `length` tokens
    expected = docs.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / (TOKEN_BYTES * length)).first()[0]
    return packed(pieces(docs, tokenizer, length), -(-int(expected) // GROUP), length, opening)
