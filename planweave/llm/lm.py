"""Scoring by a log-bilinear language model trained with noise-contrastive estimation.

Tokens are the lower-cased (A-Z) words of a text, parted at ASCII white space, and an
end. The model predicts one of OUTPUTS outputs from the CONTEXT outputs before it: the
score of an output is its bias plus the inner product of its vector with the sum of
the context's vectors, each scaled by its place. The commonest words and the end are
outputs of their own; all other words share BUCKETS outputs by their last three bytes,
and within a bucket a word has its smoothed share of the bucket's training tokens. So
a token's probability is normalised: batched matrix products give all outputs' scores.

Training takes every training document, and every token of it, the end too, is a
target PASSES times: texts are cut into runs of RUN targets, each with the CONTEXT
outputs before it. Each task descends the NCE loss over its own runs (noise: the
outputs' frequencies), CHUNK tokens at a time and in shuffled order, and the tasks'
parameters are averaged by their numbers of targets. So the model depends on how the
input is split among tasks, as the parts' order in any stochastic descent does. WORDS
is fixed, whatever the size of the corpus.

Word counts are of all training tokens. At most HOT of the commonest words of up to
HOT_BYTES go to every task; the others' occurrences are joined with the counts.

A null text counts as empty (one token, the end). Repeated rows are scored each; null
ids count as held out by the crc32 of the empty text; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.session import stored

from .common import split_of, text_slices, whole_text

END = b"\n"  # no word has white space in it
WORDS, BUCKETS = 255, 64
OUTPUTS = WORDS + 1 + BUCKETS
CONTEXT, SIZE, PASSES = 4, 16, 2
#: Targets of a run, runs of a batch, and batches of a pass at least, however few runs there are.
RUN, BATCH, LEAST_STEPS = 32, 64, 16
NOISE, STEP = 64, 0.3
#: Noise words that each target counts for in the loss.
NOISE_EACH = 16
HOT, HOT_BYTES = 200_000, 64
SMOOTH = 0.1
SEED = 7
#: Bytes of text that are worked on at once.
SLICE = 2 << 20
#: Tokens whose windows a task holds to pass over them.
CHUNK = 2_000_000
CACHE = 400_000


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all tokens of `docs`."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in text_slices(batches):
            for text in batch.column(0).to_pylist():
                found.update(tokens(text))
            if len(found) > CACHE:
                yield out()
        yield out()

    return docs.select(whole_text().cast("binary").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows of the words: totals, the commonest words' counts, and each bucket's tokens and words."""

    total: int
    distinct: int
    hot: dict[bytes, int]
    outputs: dict[bytes, int]
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray
    frequency: np.ndarray

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    def within(self, count: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return np.log10((count + SMOOTH) / (self.bucket_tokens[bucket] + SMOOTH * (self.bucket_words[bucket] + 1)))


#: A bucket is the top bits of the last three bytes, as one number, times this constant modulo 2**32.
SPREAD, WRAP = 2654435761, 1 << 32


def bucket_of(word: bytes) -> int:
    return int.from_bytes(word[-3:], "big") * SPREAD % WRAP * BUCKETS // WRAP


def buckets_of(words: list[bytes]) -> np.ndarray:
    """bucket_of each word (none is empty), all at once."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat, ends = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(sizes)
    last = flat[ends - 1] + np.where(sizes > 1, flat[ends - 2] << 8, 0) + np.where(sizes > 2, flat[ends - 3] << 16, 0) if len(words) else ends
    return last * SPREAD % WRAP * BUCKETS // WRAP


def bucket_column(word: Column) -> Column:
    last = F.conv(F.hex(F.substring(word, -3, 3)), 16, 10).cast("bigint")
    return F.floor(last * SPREAD % WRAP * BUCKETS / WRAP).cast("int")


def outputs_of(words: list[bytes], own: dict[bytes, int]) -> np.ndarray:
    """Each word's output."""
    get = own.get
    found = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
    rest = np.flatnonzero(found < 0)
    found[rest] = WORDS + 1 + buckets_of([words[i] for i in rest])
    return found


class Codes(dict):
    """Words' outputs, kept."""

    def __init__(self, own: dict[bytes, int]):
        super().__init__(own)
        self.own = own

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
            self.update(self.own)
            if word in self.own:
                return self.own[word]
        self[word] = found = WORDS + 1 + bucket_of(word)
        return found


def vocabulary(counts: DataFrame, hot: int = HOT) -> Vocabulary:
    # as many of the commonest words as `hot` at most: down to a count that the counts' histogram gives
    level = F.floor(F.log2("n") * 8).cast("int")
    steps = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("level")).collect()
    held, lowest = 0, None
    for r in steps:
        held += r["words"]
        if held > hot:
            break
        lowest = r["level"]
    common = counts.filter((level >= (lowest if lowest is not None else 1 << 30)) & (F.octet_length("word") <= HOT_BYTES)).toArrow()
    known = sorted(zip(common["word"].to_pylist(), common["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    own = [END] + [w for w, _ in known if w != END][:WORDS]
    outputs = {w: i for i, w in enumerate(own)}
    shares = {r["bucket"]: r for r in counts.groupBy(bucket_column(F.col("word")).alias("bucket")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).collect()}
    counted = dict(known)
    if END not in counted:  # rarer than the commonest words: it is an output all the same
        counted[END] = counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size, words = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r in shares.items():
        size[b], words[b] = r["tokens"], r["words"]
    frequency = np.zeros(OUTPUTS)
    for w, i in outputs.items():
        frequency[i] = counted.get(w, 0)
        size[bucket_of(w)] -= counted.get(w, 0)
        words[bucket_of(w)] -= counted.get(w, 0) > 0
    frequency[WORDS + 1 :] = size
    return Vocabulary(sum(r["tokens"] for r in steps), sum(r["words"] for r in steps), counted, outputs, size, words, (frequency + 1) / (frequency + 1).sum())


#: Shapes of the parameters: vectors of context outputs (the last is for before the text), places, outputs, biases.
SHAPES = ((OUTPUTS + 1, SIZE), (CONTEXT, SIZE), (OUTPUTS, SIZE), (OUTPUTS,))


#: Where each of them ends.
ENDS = np.cumsum([int(np.prod(s)) for s in SHAPES]).tolist()


def unpacked(flat: np.ndarray) -> list[np.ndarray]:
    return [flat[a:b].reshape(s) for a, b, s in zip([0, *ENDS[:-1]], ENDS, SHAPES, strict=True)]


def initial(frequency: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    parts = [rng.normal(0, 0.1, SHAPES[0]), np.ones(SHAPES[1]), rng.normal(0, 0.1, SHAPES[2]), np.log(frequency)]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


class Trainer:
    """Descends the NCE loss over runs, a batch at a time, with steps scaled by past gradients."""

    def __init__(self, flat: np.ndarray, frequency: np.ndarray, seed: int):
        self.flat, self.rng = flat.copy(), np.random.default_rng([SEED, seed])
        self.upto = np.cumsum(frequency) / frequency.sum()
        self.second = np.full(len(flat), 1e-3, np.float32)
        self.log_noise = np.log(NOISE_EACH * frequency).astype(np.float32)
        self.targets = 0

    def fit(self, runs: np.ndarray) -> None:
        """runs: rows of CONTEXT outputs before, farthest first, and the targets; a target of no output is left out."""
        context, places, vectors, biases = unpacked(self.flat)
        at = runs.astype(np.int64)
        size = at.shape[1] - CONTEXT
        live = (at[:, CONTEXT:] < OUTPUTS).ravel()
        target = np.minimum(at[:, CONTEXT:], OUTPUTS - 1).ravel()
        noise = np.minimum(self.upto.searchsorted(self.rng.random(NOISE), "right"), OUTPUTS - 1)
        # a token's vector is looked up once, whatever the number of targets that it is before; runs lie flat, so that whole runs are multiplied
        rows = context.take(at, axis=0).reshape(len(at), -1)
        before = [slice(p * SIZE, (p + size) * SIZE) for p in range(CONTEXT)]
        scales = np.tile(places, size)
        predicted = rows[:, before[0]] * scales[0]
        for p in range(1, CONTEXT):
            predicted += rows[:, before[p]] * scales[p]
        # with a one beside each, so that biases go with the vectors
        whole = np.ones((len(target), SIZE + 1), np.float32)
        whole[:, :SIZE] = predicted.reshape(-1, SIZE)
        over = np.column_stack([vectors, biases - self.log_noise])
        towards, away = over.take(target, axis=0), over.take(noise, axis=0)
        true = np.einsum("nd,nd->n", whole, towards)
        true = ((0.5 * np.tanh(0.5 * true) - 0.5) * live)[:, None]
        # the same of the noise, in place: half of (1 + tanh of the half)
        false = whole @ (0.5 * away.T)
        np.tanh(false, out=false)
        false += 1
        false *= 0.5 * NOISE_EACH / NOISE
        if not live.all():
            false[~live] = 0
        by_predicted = false @ away[:, :SIZE]
        by_predicted += true * towards[:, :SIZE]
        by_run = by_predicted.reshape(len(at), -1)
        by_token = np.zeros_like(rows)
        for p in range(CONTEXT):
            by_token[:, before[p]] += by_run * scales[p]
        # both sums of rows at once: by the tokens before, and by the targets
        n = at.size
        columns = np.empty((SIZE, n + len(target)))
        columns[:, :n] = by_token.reshape(-1, SIZE).T
        columns[:, n:] = (true * whole[:, :SIZE]).T
        summed = added(np.concatenate([at.ravel(), target + OUTPUTS + 1]), columns, 2 * OUTPUTS + 1)
        drawn = np.zeros((OUTPUTS, NOISE), np.float32)
        drawn[noise, np.arange(NOISE)] = 1
        gradient = np.empty_like(self.flat)
        by_context, by_places, by_vectors, by_biases = unpacked(gradient)
        by_context[:] = summed[: OUTPUTS + 1]
        for p in range(CONTEXT):
            by_places[p] = (rows[:, before[p]] * by_run).sum(axis=0).reshape(size, SIZE).sum(axis=0)
        by_noise = drawn @ (whole.T @ false).T
        np.add(summed[OUTPUTS + 1 :], by_noise[:, :SIZE], out=by_vectors)
        by_biases[:] = np.bincount(target, true[:, 0], OUTPUTS) + by_noise[:, SIZE]
        found = int(live.sum())
        gradient /= max(1, found)
        self.second += gradient**2
        self.flat -= STEP * gradient / np.sqrt(self.second)
        self.targets += found

    def passed(self, runs: np.ndarray) -> None:
        """Descend over the runs PASSES times, each time in another order, in LEAST_STEPS steps at least."""
        batch = max(1, min(BATCH, len(runs) // LEAST_STEPS))
        for _ in range(PASSES):
            order = self.rng.permutation(len(runs))
            for at in range(0, len(order), batch):
                self.fit(runs[order[at : at + batch]])


def added(at: np.ndarray, columns: np.ndarray, rows: int) -> np.ndarray:
    """The sums, by `at`, of each of the columns."""
    out = np.empty((rows, len(columns)), np.float32)
    for i, column in enumerate(columns):
        out[:, i] = np.bincount(at, column, rows)
    return out


def windows_of(outputs: np.ndarray, sizes: np.ndarray, run: int = 1) -> np.ndarray:
    """Rows of CONTEXT outputs and the `run` that follow, with every token of the texts once among the latter: texts of `sizes` tokens lie one after the other in `outputs`."""
    # so many places of no word before a text that no token of another is before its own
    lies = np.arange(len(outputs)) + CONTEXT * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    long = len(outputs) + CONTEXT * (len(sizes) + 1)
    apart = np.full(CONTEXT + -(-(long - CONTEXT) // run) * run, OUTPUTS, outputs.dtype)
    apart[lies] = outputs
    windows = np.lib.stride_tricks.sliding_window_view(apart, CONTEXT + run)[::run]
    return windows[(windows[:, CONTEXT:] < OUTPUTS).any(axis=1)]


def trained(docs: DataFrame, words: Vocabulary) -> np.ndarray:
    flat = initial(words.frequency)
    said = docs.sparkSession.sparkContext.broadcast((flat, words.frequency, words.outputs))

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        flat, frequency, outputs = said.value
        trainer, held, sizes = Trainer(flat, frequency, TaskContext.get().partitionId()), [], []
        code = Codes(outputs).__getitem__

        def train() -> None:
            if held:
                trainer.passed(windows_of(np.concatenate(held), np.concatenate(sizes), RUN))
                held.clear()
                sizes.clear()

        for batch in text_slices(batches, SLICE):
            texts = [tokens(t) for t in batch.column(0).to_pylist()]
            sizes.append(np.array([len(t) for t in texts]))
            held.append(np.fromiter(map(code, chain.from_iterable(texts)), np.int16, sizes[-1].sum()))
            if sum(map(len, held)) >= CHUNK:
                train()
        train()
        if trainer.targets:
            yield pa.RecordBatch.from_pydict({"n": [trainer.targets], "flat": [trainer.flat.tolist()]}, pa.schema([("n", pa.int64()), ("flat", pa.list_(pa.float32()))]))

    texts = docs.select(whole_text().cast("binary").alias("text"))
    each = texts.mapInArrow(fit, "n long, flat array<float>").select("n", F.posexplode("flat").alias("at", "value"))
    mean = each.groupBy("at").agg((F.sum(F.col("value").cast("double") * F.col("n")) / F.sum("n")).alias("value")).toArrow()
    if mean.num_rows:
        flat = flat.copy()
        flat[mean["at"].to_numpy()] = mean["value"].to_numpy().astype(np.float32)
    return flat


def log_probabilities(flat: np.ndarray, outputs: np.ndarray, begins: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """log10 of each output given those before it in its text; `begins` marks the texts' first tokens."""
    context, places, vectors, biases = unpacked(flat)
    n, out = len(outputs), np.empty(len(outputs))
    place = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    # a context's vector as scaled by its place, one row for each pair of them, those of no word at the ends
    scaled = (context * places[:, None, :]).reshape(-1, SIZE)
    before = np.full((CONTEXT, n), OUTPUTS)
    for back in range(1, CONTEXT + 1):
        there = place >= back
        before[CONTEXT - back, there] = outputs[np.flatnonzero(there) - back]
    before += np.arange(CONTEXT)[:, None] * (OUTPUTS + 1)
    # with a one beside each sum, so that biases go with the vectors
    predicted = np.ones((min(n, chunk), SIZE + 1), np.float32)
    columns = np.ascontiguousarray(np.column_stack([vectors, biases]).T)
    held, ones, rows = np.empty((min(n, chunk), OUTPUTS), np.float32), np.ones(OUTPUTS, np.float32), np.arange(min(n, chunk))
    for at in range(0, n, chunk):
        part = slice(at, min(at + chunk, n))
        size = part.stop - at
        sums = predicted[:size]
        sums[:, :SIZE] = scaled.take(before[:, part].ravel(), axis=0).reshape(CONTEXT, size, SIZE).sum(axis=0)
        scores = np.matmul(sums, columns, out=held[:size])
        chosen = scores[rows[:size], outputs[part]].astype(float)
        total = np.exp(scores, out=scores) @ ones
        if not np.isfinite(total).all():  # scores so high that their exponentials need the highest taken off first
            scores = sums @ columns
            top = scores.max(axis=1)
            chosen, total = chosen - top, np.exp(scores - top[:, None]).sum(axis=1)
        out[part] = (chosen - np.log(total)) / np.log(10)
    return out


class Places(dict):
    """Words' places among the commonest, -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


ROWS = "key long, doc_id {kind}, n_tokens long, n_known long, base double, score double, word binary, n long, bucket int"


def scored(docs: DataFrame, counts: DataFrame, words: Vocabulary, flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hot = list(words.hot)
    said = docs.sparkSession.sparkContext.broadcast((flat, words, hot))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        flat, words, hot = said.value
        place, key = Places({w: i for i, w in enumerate(hot)}).__getitem__, TaskContext.get().partitionId() << 40
        count = np.array([words.hot[w] for w in hot], float)
        output = outputs_of(hot, words.outputs)
        base = words.base(count)
        within = np.where(output > WORDS, words.within(count, np.maximum(0, output - WORDS - 1)), 0.0)
        names = [x.split()[0] for x in ROWS.format(kind=kind).split(", ")]
        for batch in text_slices(batches, SLICE):
            texts = [tokens(t) for t in batch.column(1).to_pylist()]
            said_words, sizes = list(chain.from_iterable(texts)), np.array([len(t) for t in texts])
            first, n_docs = np.cumsum(sizes) - sizes, len(texts)
            at = np.fromiter(map(place, said_words), np.int64, len(said_words))
            have, rare = at >= 0, np.flatnonzero(at < 0)
            rare_words = [said_words[i] for i in rare]
            buckets = buckets_of(rare_words)
            outputs = output[at]
            outputs[rare] = WORDS + 1 + buckets
            begins = np.zeros(len(at), bool)
            begins[first] = True
            likely = log_probabilities(flat, outputs, begins) + np.where(have, within[at], 0.0)
            total = lambda x: np.add.reduceat(x, first)
            keys = key + np.arange(n_docs)
            key += n_docs
            of, gap = np.searchsorted(first, rare, "right") - 1, len(rare)
            # a document's own row has a word of its own too, so that the rows of no word don't meet in one task
            own = [b" %d" % k for k in keys]
            padded = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(gap, t)])
            filled = lambda x, t: pa.array(np.concatenate([np.zeros(n_docs, np.int64), x]), t)
            columns = [
                pa.array(np.concatenate([keys, keys[of]]), pa.int64()), pa.concat_arrays([batch.column(0), pa.nulls(gap, batch.schema.field(0).type)]),
                padded(sizes, pa.int64()), padded(total((have & (count[at] > 0)).astype(np.int64)), pa.int64()), padded(total(np.where(have, base[at], 0.0)), pa.float64()), padded(total(likely), pa.float64()),
                pa.array(own + rare_words, pa.binary()), filled(np.ones(gap, np.int64), pa.int64()), filled(buckets, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select("doc_id", whole_text().cast("binary").alias("text")).mapInArrow(run, ROWS.format(kind=kind))
    rows = rows.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    c = F.coalesce("c", F.lit(0)) + F.lit(SMOOTH)
    sizes = F.array(*(F.lit(float(a + SMOOTH * (b + 1))) for a, b in zip(words.bucket_tokens, words.bucket_words, strict=True)))
    return rows.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.lit(0)) + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + F.col("n") * F.log10(c / F.lit(words.total + SMOOTH * (words.distinct + 1)))).alias("base_score"),
        F.sum(F.coalesce("score", F.lit(0.0)) + F.col("n") * F.log10(c / F.get(sizes, F.col("bucket")))).alias("score"),
    ).drop("key")


def report(docs: DataFrame, parts: int = 10, held: int = 0, hot: int = HOT) -> DataFrame:
    """Learn from the documents that aren't held out; score all."""
    learnt = docs.filter(split_of("doc_id", parts) != held)
    counts = stored(word_counts(learnt), "counts")
    words = vocabulary(counts, hot)
    out = scored(docs, counts, words, trained(learnt, words))
    return out.select("doc_id", (split_of("doc_id", parts) == held).alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")


