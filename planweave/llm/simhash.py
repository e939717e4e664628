"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint is taken of a text's three-word shingles. Two fingerprints at
most 3 bits apart have a variant in common that is at most one bit from the one and
two bits from the other, so every distinct fingerprint emits its variants and meets
its neighbours by an equi-join on them:

* all 65 variants within one bit ("near");
* those with two bits changed ("far"). Fingerprints that differ in exactly 3 bits
  differ in parity, so only those of odd parity need emit them, and two of the 3 bits
  lie in the same half, so only pairs of bits of one half are needed.

Whoever is near a variant is within 3 bits of all that emit it, near or far, so a
variant's members are linked to its least near member: one link a row, never pairs
of a group, and a variant has at most 65 near and 2016 far members as fingerprints
are distinct. Colliding pairs are deduplicated and their distance verified.

A sieve goes before: of 6 blocks of bits, fingerprints within 3 bits agree in at
least 3, so one that agrees with no other in any 3 blocks emits nothing.

Null, empty and blank texts have the fingerprint 0 and are linked like any other.
Copies share a fingerprint and never multiply. Null doc_ids take part but name no
component unless all of it is null. Repeated rows each get a row; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.session import discard, stored

from .common import text_slices, whole_text

WORDS = 3
RADIUS = 3


def simhash(text: bytes, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash

    parts = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64, max(1, len(parts) - words + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            prints = pa.array([simhash(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(masks: Iterable[int]) -> Column:
    return F.expr(f"array({', '.join(f'{_signed(m)}L' if _signed(m) > -(1 << 63) else '(-9223372036854775807L - 1L)' for m in masks)})")


def block_masks() -> list[int]:
    """The bits that any 3 of 6 blocks hold."""
    edges = [round(64 * i / 6) for i in range(7)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [reduce(int.__or__, c) for c in combinations(blocks, 3)]


def near_masks() -> list[int]:
    return [0, *(1 << i for i in range(64))]


def far_masks() -> list[int]:
    return [1 << i | 1 << j for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]


def crowded(prints: DataFrame) -> DataFrame:
    """Those of the distinct fingerprints that agree with another in some 3 of the 6 blocks."""
    keys = prints.select("fp", F.posexplode(F.transform(_masks(block_masks()), lambda m: F.col("fp").bitwiseAND(m))).alias("which", "key"))
    shared = keys.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("which", "key")
    return keys.join(shared, ["which", "key"], "left_semi").select("fp").distinct()


def links(prints: DataFrame) -> DataFrame:
    """fp, hub: verified links between distinct fingerprints that join all that are within 3 bits."""
    some = crowded(prints)
    emit = lambda masks: F.explode(F.transform(_masks(masks), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant")
    near = some.select("fp", emit(near_masks()), F.lit(True).alias("near"))
    far = some.filter(F.bit_count("fp") % 2 == 1).select("fp", emit(far_masks()), F.lit(False).alias("near"))
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("variant"))
    pairs = near.union(far).withColumn("hub", hub).filter("hub is not null and fp <> hub").select("fp", "hub").distinct()
    return pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the least node that each node is linked with, over any number of links.

    Large-star and small-star steps in turn until nothing changes; each step's
    links are written to the shared folder, so a lost executor costs one step.
    """
    now = stored(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    weight = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    seen = weight(now)
    while True:
        both = now.union(now.select("lo", "hi")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = both.filter("other > node").join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("least").alias("lo"))
        after = stored(small.distinct(), "links")
        done, seen = (weight(after) == seen), weight(after)
        discard(now)
        now = after
        if done:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root (the least fingerprint of its component), component_id (the least doc_id)."""
    own = stored(fingerprints(docs), "fingerprints")
    prints = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints.select("fp")), "fp", "hub")
    # both sides of the next join are written first and so shuffled for it: a component of very many fingerprints can be split
    named = stored(prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    return own.join(named.select("fp", "root").join(least, "root"), "fp")


def report(docs: DataFrame) -> DataFrame:
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return near_duplicates(docs).select("doc_id", text("fp").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with one of each component: that of the least doc_id (of repeated ones the least text); rows without doc_id are kept only where their whole component has none, one row."""
    found = near_duplicates(docs)
    named = found.filter("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("other")).distinct()
    # rows travel whole in one column, so theirs may have any names
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    once = Window.partitionBy("row.doc_id").orderBy("row.text")
    out = rows.filter("row.doc_id is not null").join(named, F.col("row.doc_id") == F.col("other"), "left_anti")
    out = out.withColumn("nth", F.row_number().over(once)).filter("nth = 1").select("row.*")
    bare = rows.filter("row.doc_id is null")
    if bare.isEmpty():
        return out
    lone = found.filter("component_id is null").select("fp", "root").distinct()
    keys = bare.select(F.xxhash64("row.text").alias("doc_id"), F.col("row.text").alias("text"))
    prints = fingerprints(keys).distinct().withColumnRenamed("doc_id", "key").join(lone, "fp")
    keyed = bare.withColumn("key", F.xxhash64("row.text")).join(prints, "key")
    # only one row of a component leaves each task, so components of very many meet in few
    first = Window.partitionBy("root").orderBy("fp", "row.text")
    return out.unionByName(keyed.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row.*"))
