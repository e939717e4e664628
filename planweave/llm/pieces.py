"""SentencePiece encoding and decoding.

`lattice_encode` is the relational lattice: the distinct words' substrings no longer
than the longest piece are joined with the piece table, the edges grouped by word, and
the best path folded by a higher-order aggregate. The best path is what a unigram piece
table means; `word_paths` takes the distinct words of all texts through one.

The vocabulary given here is a BPE one, and what it means is another segmentation:
the best-scored neighbours are merged until none can be. No path score gives that
(README has the shares that differ), so `encoded` merges, each word once per worker,
with the piece table as its only input, and tests hold it against the library.

A space becomes the mark "▁" and one goes before a text; a piece never has a mark
after another character, so words can be encoded alone. Characters without a piece
become their bytes' pieces. Null text counts as empty and has no ids; decoding gives
the text back but for "▁" itself, which comes back as a space. Repeated rows are
encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.session import stored

from .common import text_slices, whole_text

MARK = "▁"
CACHE, CACHED_CHARS = 400_000, 48
WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Longer words are merged by a heap; characters that are exploded together; back steps that a fold gathers in one array.
SHORT, PART, GATHERED = 64, 1000, 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_rows(path: str) -> list[tuple[str, int, float, str]]:
    """piece, id, score, kind (piece, byte or control) of a model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
    return [(model.id_to_piece(i), i, model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    return spark.createDataFrame(piece_rows(path or default_model()), "piece string, id int, score double, kind string")


def unigram_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The model's pieces with log-probabilities by Zipf's law over their order: a unigram table made of a BPE one."""
    rows = [(p, i, -float(np.log(i + 1)), kind) for p, i, _, kind in piece_rows(path or default_model())]
    return spark.createDataFrame(rows, "piece string, id int, score double, kind string")


STEP = "struct<start:int,id:int>"


def _grown(full: Column, last: Column, item: Column) -> tuple[Column, Column]:
    """An array of arrays and its unfinished last one, with one item more: no step copies all that is there."""
    done = F.size(last) >= GATHERED
    return F.when(done, F.concat(full, F.array(last))).otherwise(full), F.when(done, F.array(item)).otherwise(F.concat(last, F.array(item)))


def _path(edges: Column, longest: int) -> Column:
    """ids of the best path; edges: array<struct<end,start,id,score>> in order, with one at least for every end."""

    def step(acc, e):
        begins = F.size(acc["recent"]) - 1
        total = F.get(acc["recent"], e["start"] - acc["at"] + begins) + e["score"]
        here, back = e["end"] == acc["at"], F.struct(e["start"].alias("start"), e["id"].alias("id"))
        better = here & (total > F.element_at(acc["recent"], -1))
        behind = F.when(here, F.slice(acc["recent"], F.lit(1), begins)).otherwise(F.slice(acc["recent"], F.greatest(F.lit(1), begins - longest + 2), F.lit(longest)))
        full, last = _grown(acc["full"], acc["last"], acc["back"])
        return F.struct(
            e["end"].alias("at"),
            F.when(here & ~better, acc["recent"]).otherwise(F.concat(behind, F.array(total))).alias("recent"),
            F.when(here & ~better, acc["back"]).otherwise(back).alias("back"),
            F.when(here, acc["full"]).otherwise(full).alias("full"),
            F.when(here, acc["last"]).otherwise(last).alias("last"),
        )

    def walk(acc):
        return F.aggregate(F.array(F.lit(0)), F.flatten(F.concat(acc["full"], F.array(F.concat(acc["last"], F.array(acc["back"]))))), lambda held, _: held, back_from_end)

    def back_from_end(backs):
        def one(t, _):
            here = F.get(backs, t["at"])
            full, last = _grown(t["full"], t["last"], here["id"])
            return F.when(t["at"] > 0, F.struct(here["start"].alias("at"), full.alias("full"), last.alias("last"))).otherwise(t)

        init = F.struct((F.size(backs) - 1).alias("at"), F.array().cast("array<array<int>>").alias("full"), F.array().cast("array<int>").alias("last"))
        return F.aggregate(backs, init, one, lambda t: F.reverse(F.flatten(F.concat(t["full"], F.array(t["last"])))))

    start = F.struct(
        F.lit(0).alias("at"), F.array(F.lit(0.0)).alias("recent"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("id")).alias("back"),
        F.array().cast(f"array<array<{STEP}>>").alias("full"), F.array().cast(f"array<{STEP}>").alias("last"),
    )
    return F.aggregate(edges, start, step, walk)


def lattice_encode(words: DataFrame, pieces: DataFrame, longest: int | None = None, unknown: int = 0) -> DataFrame:
    """word, ids of its best path through `pieces` (piece, id, score); a character of no piece is `unknown`, under all scores.

    Substrings are as long as the longest piece, or as `longest` says. Words have
    numbers of their own, so no row of the lattice carries a whole word, and are
    exploded PART characters at a time. The pieces, a model's, are sent to the substrings,
    so only edges are shuffled. A word's edges meet in one row. Ties go to the longer last piece.
    """
    table = pieces.filter("kind = 'piece'").select("piece", "id", "score")
    least, most = table.agg(F.min("score"), F.max(F.length("piece"))).first()
    least, most = (least or 0.0) - 10, longest or most or 1
    dealt = stored(words.select("word").filter("word <> ''").distinct().withColumn("number", F.monotonically_increasing_id()), "words")
    size = F.length("word")
    parts = dealt.select("number", "word", size.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / PART).cast("int"))).alias("part"))
    parts = parts.select("number", "n", (F.col("part") * PART).alias("from"), F.substring("word", F.col("part") * PART + 1, F.lit(PART + most - 1)).alias("text"))
    at = parts.select("number", "from", "text", F.explode(F.sequence(F.lit(0), F.least(F.lit(PART - 1), F.col("n") - F.col("from") - 1))).alias("start"))
    at = at.select("number", "from", "start", "text", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.length("text") - F.col("start")))).alias("size"))
    spans = at.select("number", (F.col("from") + F.col("start")).alias("start"), "size", F.substring("text", F.col("start") + 1, F.col("size")).alias("piece"))
    edges = spans.join(F.broadcast(table), "piece", "left").filter("id is not null or size = 1")
    edge = F.struct((F.col("start") + F.col("size")).alias("end"), "start", F.coalesce("id", F.lit(unknown)).alias("id"), F.coalesce("score", F.lit(least)).alias("score"))
    grouped = edges.groupBy("number").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    return dealt.join(grouped.select("number", _path(F.col("edges"), most).alias("ids")), "number").select("word", "ids")


def word_paths(docs: DataFrame, pieces: DataFrame, unknown: int = 0) -> DataFrame:
    """word (with its marks), n (how often it occurs) and ids (its best path) of the words of all texts.

    Null and empty texts have no words; repeated rows count; an empty table gives no rows.
    """
    text = F.when(whole_text() != "", F.concat(F.lit(MARK), F.replace(whole_text(), F.lit(" "), F.lit(MARK))))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(WORD.pattern), F.lit(0))).alias("word"))
    counts = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    return counts.join(lattice_encode(counts, pieces, unknown=unknown), "word")


class Merger:
    """Ids of words by merging neighbours, best score first, the leftmost of equals."""

    def __init__(self, rows: list[tuple[str, int, float, str]]):
        self.ids = {p: i for p, i, _, kind in rows if kind == "piece"}
        self.score = {p: s for p, _, s, kind in rows if kind == "piece"}
        self.bytes = {int(p[3:5], 16): i for p, i, _, kind in rows if kind == "byte"}
        self.texts = {i: p for p, i, _, kind in rows if kind == "piece"}
        self.unbyte = {i: b for b, i in self.bytes.items()}
        self.known: dict[str, bytes] = {}

    def merged(self, word: str) -> list[str]:
        if len(word) > SHORT:
            return self.merged_long(word)
        parts, score = list(word), self.score.get
        scores = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            at, best = -1, None
            for i, s in enumerate(scores):
                if s is not None and (best is None or s > best):
                    at, best = i, s
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1])
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at])

    def merged_long(self, word: str) -> list[str]:
        """The same by a heap of the merges that are open, over linked neighbours: n log n."""
        parts, score, n = list(word), self.score.get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        open_merges: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < n:
                both = parts[left] + parts[after[left]]
                s = score(both)
                if s is not None:
                    heapq.heappush(open_merges, (-s, left, both))

        for i in range(n - 1):
            offer(i)
        while open_merges:
            _, left, both = heapq.heappop(open_merges)
            right = after[left]
            # merges whose parts have changed since are out of date
            if parts[left] is None or right >= n or len(parts[left]) + len(parts[right]) != len(both) or parts[left] + parts[right] != both:
                continue
            parts[left], parts[right] = both, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return [x for x in parts if x is not None]

    def word(self, word: str) -> bytes:
        ids: list[int] = []
        for piece in self.merged(word):
            found = self.ids.get(piece)
            ids += [found] if found is not None else [self.bytes[b] for b in piece.encode()]
        out = np.array(ids, "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        known, word = self.known.get, self.word
        return b"".join([known(w) or word(w) for w in WORD.findall(MARK + text.replace(" ", MARK))]) if text else b""

    def decode(self, ids: Iterable[int]) -> str:
        texts, unbyte = self.texts, self.unbyte
        out = b"".join([texts[i].encode() if i in texts else bytes([unbyte[i]]) for i in ids]).decode()
        return out.replace(MARK, " ")[1:]


@functools.cache
def merger(path: str) -> Merger:
    """One for all tasks of a worker."""
    return Merger(piece_rows(path))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the whole text's."""
    path = path or default_model()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = merger(path)
        for batch in text_slices(batches):
            ids = [np.frombuffer(use.encode(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    path = path or default_model()
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = merger(path)
        for batch in batches:
            texts = [use.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256 and whether decoding gave the text back."""
    path = path or default_model()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = merger(path)
        for batch in text_slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = use.encode(text)
                back = use.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(MARK, " ")))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
