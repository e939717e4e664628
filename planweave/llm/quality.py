"""Quality by ordinal cumulative-link regression on graded ratings.

A document has one score, a linear function of hashed features of its text: words,
shapes of words (letters, capitals, digits and signs, runs shortened), shapes of
neighbours, and how often a word repeats the one before; each as the square root of
its share. A grade of at least k has probability logistic(score - threshold k), all
grades sharing the weights and the thresholds being in order. Selection goes by the
expected grade or by a tail probability.

The model is fitted in numpy on at most SAMPLE rated documents of each grade, and at
most toxicity.SAMPLE_BYTES of text, taken by a hash of doc_id at a rate from the counts
of the ratings that have a document (one row an id, none over toxicity.LONGEST bytes),
and each counts for as many as its grade's rate left out, so the thresholds are those
of all rated documents and KEEP means the same at any size. Ratings are whole numbers of
any range; with a single grade every document gets it. Null, empty and blank texts
have no features and get the grade that the thresholds alone give; null ratings are
not learnt from; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_along, split_of, row_slices, texts_of, with_fields
from .toxicity import labelled_texts

#: Most documents of a grade that the model is fitted on.
SAMPLE = 2000
BUCKETS = 1 << 18
ROUNDS, STEP, SHRINK, LEAST_DOCS = 150, 0.3, 1e-4, 5
CACHE = 150_000
RUNS = (re.compile(r"[^\W\d_a-zà-öø-ÿß]{2,}"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]{2,}"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1+"))


def shape(word: str) -> str:
    word = RUNS[3].sub(r"\1\1", word)
    return RUNS[2].sub("0", RUNS[1].sub("a", RUNS[0].sub("A", word)))[:12]


class Features(dict):
    """Words' features and shapes, kept."""

    def __missing__(self, word: str) -> tuple[tuple[int, int], str]:
        if len(self) > CACHE:
            self.clear()
        form = shape(word)
        self[word] = found = ((zlib.crc32(b"w" + word.lower().encode()) % BUCKETS, zlib.crc32(b"s" + form.encode()) % BUCKETS), form)
        return found

    def of(self, text: str) -> dict[int, float]:
        words = text.split()
        counts: Counter = Counter()
        for word, n in Counter(words).items():
            for f in self[word][0]:
                counts[f] += n
        forms = [self[w][1] for w in words]
        for (a, b), n in Counter(zip(forms, forms[1:], strict=False)).items():
            counts[zlib.crc32(f"n{a} {b}".encode()) % BUCKETS] += n
        again = sum(map(eq, words, words[1:]))
        if again:
            counts[zlib.crc32(b"again") % BUCKETS] += again
        total = max(1, len(words))
        return {f: (n / total) ** 0.5 for f, n in counts.items()}


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    #: The rating of each grade, in order, and the thresholds between them.
    grades: list[int]
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k), one column for each grade above the lowest."""
        return logistic(scores[:, None] - self.thresholds[None, :])

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(scores) @ np.diff(np.array(self.grades, float))


def train(texts: list[str], ratings: list[int], counts_for: list[float] | None = None) -> Model:
    """The model; each text counts for one, or for as many as `counts_for` says."""
    grades = sorted(set(ratings)) or [0]
    weights = np.zeros(BUCKETS)
    if len(grades) < 2:  # nothing to tell apart
        return Model(weights, grades, np.zeros(0))
    known, feature, value, doc = Features(), [], [], []
    for d, text in enumerate(texts):
        found = known.of(text)
        feature.append(np.fromiter(found.keys(), np.int32, len(found)))
        value.append(np.fromiter(found.values(), np.float64, len(found)))
        doc.append(np.full(len(found), d, np.int32))
    feature, value, doc = map(np.concatenate, (feature, value, doc))
    del known
    kept = np.bincount(feature, minlength=BUCKETS)[feature] >= LEAST_DOCS
    feature, value, doc = feature[kept], value[kept], doc[kept]
    y = np.searchsorted(grades, ratings)
    share = np.ones(len(texts)) if counts_for is None else np.array(counts_for, float)
    share /= share.sum()
    # thresholds start where the grades' shares put them; their gaps are exponentials, so they stay in order
    above = np.array([share[y > k].sum() for k in range(len(grades) - 1)])
    start = -np.log(above / (1 - above))
    free = np.append(start[:1], np.log(np.maximum(np.diff(start), 1e-3)))
    spread = lambda f: np.cumsum(np.append(f[0], np.exp(f[1:])))
    second, second_free = np.full(BUCKETS, 1e-8), np.full(len(free), 1e-8)
    for _ in range(ROUNDS):
        score, cuts = np.bincount(doc, weights[feature] * value, len(texts)), spread(free)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = logistic(score - edges[y]), logistic(score - edges[y + 1])
        upper[y == 0], lower[y == len(grades) - 1] = 1.0, 0.0
        chance = np.maximum(upper - lower, 1e-12)
        by_upper, by_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        slope = -(by_upper - by_lower) * share
        by_cut = np.bincount(y, by_upper * share, len(grades) + 1)[1:-1] - np.bincount(y, by_lower * share, len(grades))[:-1]
        steps = np.append(1.0, np.exp(free[1:]))
        by_free = np.cumsum(by_cut[::-1])[::-1] * steps
        gradient = np.bincount(feature, slope[doc] * value, BUCKETS)
        second += gradient**2
        second_free += by_free**2
        pace = STEP / np.sqrt(second)
        weights -= pace * gradient
        weights = np.sign(weights) * np.maximum(0, np.abs(weights) - pace * SHRINK)
        free -= STEP * by_free / np.sqrt(second_free)
    return Model(weights, grades, spread(free))


def scored(docs: DataFrame, model: Model, whole: bool = False) -> DataFrame:
    """doc_id, expected_grade and tails (P of each grade above the lowest, or more); with `whole`, beside all columns of `docs`."""
    at = np.flatnonzero(model.weights)
    said = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), model.weights[at], model.grades, model.thresholds))
    rows, names = read_along(docs, whole)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, grades, thresholds = said.value
        mine, known = Model(np.zeros(0), grades, thresholds), Features()
        weight = dict(zip(at.tolist(), values.tolist(), strict=True)).get
        for batch in row_slices(batches):
            scores = np.array([sum(weight(f, 0.0) * x for f, x in known.of(t).items()) for t in texts_of(batch)], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(mine.expected(scores)), pa.array(list(mine.tails(scores)), pa.list_(pa.float64()))], [*names, "expected_grade", "tails"])

    return rows.mapInArrow(run, with_fields(rows.select(*names), "expected_grade double, tails array<double>"))


def fitted(docs: DataFrame, labels: DataFrame, rating: str = "quality", held: int = 1, parts: int = 3) -> Model:
    """The model from the rated documents that aren't held out."""
    return train(*labelled_texts(docs, labels.filter(split_of("doc_id", parts) != held).select("doc_id", rating), rating, SAMPLE))


#: Documents are kept whose chance of the best grade is at least this.
KEEP = 0.3


def best_tail() -> Column:
    """The chance of the highest grade; with one grade it's certain."""
    return F.coalesce(F.try_element_at("tails", F.lit(-1)), F.lit(1.0))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, tail (the chance of the highest grade) and keep."""
    out = scored(docs, fitted(docs, labels))
    return out.select("doc_id", (split_of("doc_id", 3) == 1).alias("held_out"), "expected_grade", best_tail().alias("tail"), (best_tail() >= KEEP).cast("int").alias("keep"))
