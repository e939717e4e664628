"""Ranked search by words: posting lists bucketed by term, integer scores, the best of each item.

A row of `postings` is one term in one stretch of 1024 consecutive rows of the table, with
the places in the stretch, how often the term occurs there and how many terms the document
has; a term that every document holds is many such rows, dealt out to many buckets. The row
without a term has the documents themselves. A search joins the items' terms with the lists,
turns each list into a list of whole-number scores, and sums them by item and document: what
is shuffled are lists by (item, stretch), and each stretch keeps its own best before the
window over the whole item.

Null text, and text without a term, has no postings but a row of its own. Repeated rows, and
rows with equal or null ids, are documents of their own; equal scores go by id, nulls first,
then by place. Items without terms, or none of whose terms occur, have no rows. An empty table has
no results. Columns other than those named don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.session import stored

from .common import text_slices

# What is no part of a term, and letters that are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
#: Bits of a row's place in its stretch; a term's lists meet in buckets of so many stretches.
STRETCH, TOGETHER = 10, 64
#: Rows of items' terms that are sent to all tasks; more of them are shuffled. Items that ask for a term in one row, about.
SENT, ASKING = 500_000, 4096

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
POSTINGS = "term string, stretch long, at array<smallint>, tf array<int>, n array<int>, doc_id array<{}>"


def postings(docs: DataFrame) -> DataFrame:
    """term, stretch, at, tf, n of every term of every document (doc_id, text), as lists; where term is null, doc_id instead of tf.

    The stretches are runs of rows as they are read, so the result is to be stored before it is used twice.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    ids = pa.int32() if kind.simpleString() == "int" else pa.int64() if kind.simpleString() == "bigint" else pa.string()
    return rows.mapInArrow(lambda batches: _lists(batches, ids), POSTINGS.format(kind.simpleString()))


def _lists(batches: Iterable[pa.RecordBatch], ids: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Slices of a stretch may come in several rows; they are lists all the same."""
    for batch in text_slices(batches):
        rows = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(rows >> STRETCH)) + 1).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield _stretch(int(rows[a]) >> STRETCH, (rows[a:b] & ((1 << STRETCH) - 1)).tolist(), batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a), ids)


def _stretch(stretch: int, places: list[int], doc_ids: list, texts: pa.Array, ids: pa.DataType) -> pa.RecordBatch:
    found: dict[bytes, list[int]] = {}
    sizes = []
    for at, text in zip(places, texts, strict=True):
        words = _TERM.findall(text.as_py().translate(_LOWERED))
        n = len(words)
        sizes.append(n)
        for word, tf in Counter(words).items():
            held = found.get(word)
            if held is None:
                found[word] = [at, tf, n]
            else:
                held += (at, tf, n)
    ends = np.cumsum([0, len(places), *(len(v) // 3 for v in found.values())]).astype(np.int32)
    flat = np.array([x for v in found.values() for x in v], np.int64).reshape(-1, 3)
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
    empty = np.zeros(len(places), np.int64)
    none = pa.ListArray.from_arrays(pa.array(np.array([0, len(places)] + [len(places)] * len(found), np.int32)), pa.array(doc_ids, ids))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None, *found], pa.binary()).cast(pa.string()), pa.array(np.full(len(found) + 1, stretch)),
            lists(np.concatenate([places, flat[:, 0]]).astype(np.int16), pa.int16()), lists(np.concatenate([empty, flat[:, 1]]).astype(np.int32), pa.int32()),
            lists(np.concatenate([sizes, flat[:, 2]]).astype(np.int32), pa.int32()), none,
        ],
        ["term", "stretch", "at", "tf", "n", "doc_id"],
    )


def bucketed(lists: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """`postings` by buckets of terms, of a common term in several, stored; with `terms` (term) those lists only, and the documents."""
    if terms is not None:
        asked = stored(terms.select("term").distinct().withColumn("asked", F.lit(True)), "terms")
        few = asked.count() <= SENT
        lists = lists.join(F.broadcast(asked) if few else asked, "term", "left").filter("term is null or asked").drop("asked")
    return stored(lists.repartition(F.col("term"), F.expr(f"stretch div {TOGETHER}")), "postings")


def terms_of(text: Column) -> Column:
    """A text's terms, repeats included."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda t: t != "")


def asked_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times."""
    return items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def search(lists: DataFrame, asked: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item; `lists` of `bucketed`, `asked` of `asked_terms`."""
    documents = lists.filter("term is null")
    totals = documents.select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    some = lists.filter("term is not null")
    spread = some.groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.col("docs") + 2).cast("double") / (2 * F.col("df") + 1))).cast("bigint")
    weighted = stored(asked.join(spread, "term").crossJoin(F.broadcast(totals)).select("item_id", "term", (F.col("times") * weight).alias("weight")), "weights")
    impact = F.expr("transform(arrays_zip(tf, n), x -> cast((1000000000L * x.tf) div (1000L * x.tf + 8 * (25 + (75L * x.n * docs) div words)) as int))")
    scored = some.crossJoin(F.broadcast(totals)).select("term", "stretch", "at", impact.alias("impact"))
    count = weighted.count()
    # who asks for a term, in lists of bounded length: a posting list travels once for all of them
    share = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-count // ASKING)))).alias("share")
    asks = weighted.groupBy("term", share).agg(F.collect_list(F.struct("item_id", "weight")).alias("asks"))
    met = scored.join(F.broadcast(asks) if count <= SENT else asks, "term").select("stretch", "share", "asks", "at", "impact")
    each = met.repartition("stretch", "share").select("stretch", "share", F.explode("asks").alias("ask"), "at", "impact")
    each = each.select("stretch", "share", "ask.item_id", "ask.weight", F.explode(F.arrays_zip("at", "impact")).alias("x"))
    sums = each.groupBy("item_id", "stretch", "share", F.col("x.at").alias("at")).agg(F.sum(F.col("weight") * F.col("x.impact")).alias("score")).filter("score > 0")
    local = F.rank().over(Window.partitionBy("item_id", "stretch", "share").orderBy(F.desc("score")))
    best = sums.withColumn("place", local).filter(F.col("place") <= k).drop("place", "share")
    names = documents.select("stretch", F.explode(F.arrays_zip("at", "doc_id")).alias("x")).select("stretch", "x.at", "x.doc_id")
    ordered = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "stretch", "at"))
    return best.join(names, ["stretch", "at"]).withColumn("rank", ordered).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: each item's TOP documents among all of `docs`."""
    asked = stored(asked_terms(items), "asked")
    return search(bucketed(postings(docs), asked), asked)
