"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability, logistic in its
hashed words and word beginnings; a document's is their noisy-or, one minus the
product of the complements. Only documents are labelled: training ascends the
likelihood of the document labels through the noisy-or, so it learns which sentences
make a document toxic, and scoring names those sentences with their places.

The model is fitted in numpy on at most SAMPLE labelled documents of either class and
at most SAMPLE_BYTES of text, taken by a hash of doc_id at a rate from the counts of the
labels that have a document; texts over LONGEST bytes are not fitted on, and of rows
that share a doc_id one is. Each counts for as many as its class's rate left out, so the
classes weigh what they do in all labelled documents and a cut means the same at any size. Null, empty and blank
texts have no sentences and score 0; labels that are null are not learnt from;
repeated rows are scored each; an empty table gives no rows. Without labels of both
classes every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_along, split_of, row_slices, texts_of, whole_text, with_fields

#: Most documents of a class that the model is fitted on, most bytes of their texts in all, and the longest such text.
SAMPLE, SAMPLE_BYTES, LONGEST = 2000, 32 << 20, 1 << 20
#: Hashed features, fewest documents a feature must be in, fitting rounds, step and shrinkage.
BUCKETS = 1 << 18
LEAST_DOCS, ROUNDS, STEP, SHRINK = 5, 60, 1.5, 4e-4
#: A sentence is taken for clean at first: low enough that hundreds of clean sentences make a clean document.
BIAS = -9.0
THRESHOLD = 0.7
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
CACHE = 300_000
#: Words whose features the driver keeps while it trains.
TRAIN_CACHE = 100_000


def features(word: str) -> list[int]:
    """A word and its beginnings of 4 and 5 letters, hashed."""
    found = [zlib.crc32(b"w" + word.encode())]
    found += [zlib.crc32(b"p" + word[:n].encode()) for n in (4, 5) if len(word) > n]
    return [x % BUCKETS for x in found]


class Features(dict):
    """Words' features, kept."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > TRAIN_CACHE:
            self.clear()
        self[word] = found = features(word)
        return found


def sampled(labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """doc_id, label and weight (of how many rows of its class each is one) of about `most` rows of either class, by a hash of doc_id; all of a class that is no larger."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    rates = {r[0]: min(1.0, most / r["n"]) for r in labels.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(label)), F.lit(1 << 30)) / float(1 << 30)
    kept, weight = F.lit(False), F.lit(1.0)
    for value, rate in rates.items():
        kept = kept | ((F.col(label) == value) & (draw < rate))
        weight = F.when(F.col(label) == value, 1 / rate).otherwise(weight)
    return labels.filter(kept).withColumn("weight", weight)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, bytes_most: int = SAMPLE_BYTES) -> tuple[list[str], list[int], list[float]]:
    """Texts, labels and weights of the bounded sample of the labels that have a document.

    A hundredth over `most` is all that the hash lets through. Where the texts have more
    than `bytes_most` bytes, each class gives those that come first by their draw, up to
    its part of the bytes, and the rest of its weight goes to them.
    """
    fitted = docs.select("doc_id", whole_text().alias("text")).filter(F.octet_length("text") <= LONGEST)
    some = F.broadcast(sampled(labels.join(docs.select("doc_id"), "doc_id", "left_semi"), label, most))
    draw = F.xxhash64("doc_id", F.lit(label)).alias("draw")
    # one row an id: its shortest text (the least of those), found before anything is shuffled or sent
    sizes = fitted.select("doc_id", F.octet_length("text").alias("n")).join(some, "doc_id").groupBy("doc_id", label, "weight").agg(F.min("n").alias("n"))
    drawn = sizes.select("doc_id", label, "weight", "n", draw).toArrow().to_pylist()
    kept: dict = {}
    for value in {r[label] for r in drawn}:
        rows = sorted((r for r in drawn if r[label] == value), key=lambda r: (r["draw"], r["doc_id"]))
        whole, held, taken = sum(r["weight"] for r in rows), 0, []
        for r in rows:
            held += r["n"]
            if held * len({x[label] for x in drawn}) > bytes_most and taken:
                break
            taken.append(r)
        part = sum(r["weight"] for r in taken)
        kept |= {r["doc_id"]: (r["weight"] * whole / part, value) for r in taken}
    if not kept:
        return [], [], []
    # what is wanted is known by now, so texts are read once more and labels not at all
    kinds = f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, counts double, {label} {labels.schema[label].dataType.simpleString()}"
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i, *x) for i, x in kept.items()], kinds))
    least = F.min(F.struct(F.octet_length("text").alias("n"), "text")).alias("t")
    rows = fitted.join(wanted, "doc_id").groupBy("doc_id", label, "counts").agg(least)
    rows = rows.select(F.col("t.text").alias("text"), label, "counts", draw).orderBy("draw", "text").toArrow()
    return rows["text"].to_pylist(), rows[label].to_pylist(), rows["counts"].to_pylist()


def train(texts: list[str], labels: list[int], counts_for: list[float] | None = None) -> np.ndarray:
    """Weights of the hashed features, and at the end the bias; each text counts for one, or for as many as `counts_for` says."""
    weights = np.zeros(BUCKETS + 1, np.float64)
    weights[-1] = BIAS
    if len(set(labels)) < 2:
        weights[-1] = -np.inf
        return weights
    known, flat, sentence_of, doc_of, sentences = Features(), [], [], [], 0
    in_docs = np.zeros(BUCKETS, np.int32)
    for d, text in enumerate(texts):
        begun = len(flat)
        for sentence in SENTENCE.findall(text.lower()):
            found = {f for w in set(WORD.findall(sentence)) for f in known[w]}
            if found:
                flat.append(np.fromiter(found, np.int32, len(found)))
                sentence_of.append(np.full(len(found), sentences, np.int32))
                doc_of.append(d)
                sentences += 1
        if len(flat) > begun:
            in_docs[np.unique(np.concatenate(flat[begun:]))] += 1
    if not flat:  # no words to learn from
        weights[-1] = -np.inf
        return weights
    feature, sentence_of, doc_of = np.concatenate(flat), np.concatenate(sentence_of), np.array(doc_of)
    del flat, known
    kept = in_docs[feature] >= LEAST_DOCS
    feature, sentence_of = feature[kept], sentence_of[kept]
    y = np.array(labels, float)[doc_of]
    each = np.ones(len(texts)) if counts_for is None else np.array(counts_for, float)
    share = (each / each.sum())[doc_of]
    second = np.zeros_like(weights)
    for _ in range(ROUNDS):
        score = np.clip(np.bincount(sentence_of, weights[feature], sentences) + weights[-1], -30, 30)
        p = 1 / (1 + np.exp(-score))
        log_clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts))[doc_of]
        clean = np.minimum(np.exp(log_clean), 1 - 1e-12)
        # of -log likelihood by a sentence's score: p for a clean document, -p * clean / (1 - clean) for a toxic one
        slope = np.where(y > 0, -p * clean / (1 - clean), p) * share
        gradient = np.append(np.bincount(feature, slope[sentence_of], BUCKETS), slope.sum())
        second += gradient**2
        pace = STEP / (np.sqrt(second) + 1e-6)
        weights -= pace * gradient
        # what is left of a weight after its shrinkage: rare coincidences fall to nothing
        weights[:-1] = np.sign(weights[:-1]) * np.maximum(0, np.abs(weights[:-1]) - pace[:-1] * SHRINK)
    return weights


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights, self.bias, self.known = weights, float(weights[-1]), {}

    def word(self, word: str) -> float:
        if len(self.known) > CACHE:
            self.known.clear()
        self.known[word] = found = float(self.weights[features(word)].sum())
        return found

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and start, end and probability of its sentences of 0.5 or more."""
        known, bias, clean, worst = self.known, self.bias, 0.0, []
        for m in SENTENCE.finditer(text):
            score = bias
            for w in set(WORD.findall(m[0].lower())):
                got = known.get(w)
                score += self.word(w) if got is None else got
            if score > -30:
                p = 1 / (1 + np.exp(-score)) if score < 30 else 1 - 1e-13
                clean += np.log1p(-p)
                if p >= 0.5:
                    worst.append((m.start(), m.end(), float(p)))
        return float(-np.expm1(clean)), worst


SPANS = "array<struct<start:int,end:int,score:double>>"


def scored(docs: DataFrame, weights: np.ndarray, whole: bool = False) -> DataFrame:
    """doc_id, score, offending (start, end and score of the sentences that are likelier toxic than not); with `whole`, beside all columns of `docs`."""
    sparse = np.flatnonzero(weights[:-1])
    said = docs.sparkSession.sparkContext.broadcast((sparse.astype(np.int32), weights[sparse], float(weights[-1])))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    rows, names = read_along(docs, whole)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = said.value
        whole_weights = np.zeros(BUCKETS + 1)
        whole_weights[at], whole_weights[-1] = values, bias
        scorer = Scorer(whole_weights)
        for batch in row_slices(batches):
            found = [scorer.document(t) for t in texts_of(batch)]
            worst = [[dict(zip(("start", "end", "score"), s, strict=True)) for s in spans_of] for _, spans_of in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([s for s, _ in found], pa.float64()), pa.array(worst, spans)], [*names, "score", "offending"])

    return rows.mapInArrow(run, with_fields(rows.select(*names), f"score double, offending {SPANS}"))


def report(docs: DataFrame, labels: DataFrame, held: int = 1, parts: int = 3) -> DataFrame:
    """Learn from the labelled documents that aren't held out; score all."""
    weights = train(*labelled_texts(docs, labels.filter(split_of("doc_id", parts) != held).select("doc_id", "toxic"), "toxic"))
    out = scored(docs, weights)
    return out.select("doc_id", (split_of("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
