"""Document fingerprints: threshold-scaled sketches, in DataFrame expressions only.

A sketch keeps every distinct hash of a text's five-word shingles (lower-cased,
split at white space) that lies below a fixed fraction of the hash range, so its
size follows the text's and two sketches of very unequal texts are still samples
at one rate. A text none of whose hashes is that low keeps its least hash: sketches
stay mergeable (unite, then drop what is not low unless nothing is) and only a text
without words has none. Fewer than five words make one shingle.

Null text counts as empty. Two empty sketches are alike (1), an empty and another
are not (0). Repeated rows get equal fingerprints; an empty table gives no rows. Rows
of one doc_id follow each other by a hash of their text, those without doc_id come last.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

WORDS = 5
SCALE = 4
#: Documents in a block of neighbours, the most blocks, and keys for each block from which their bounds are taken.
BLOCK, MOST_BLOCKS, SAMPLED = 512, 1 << 16, 8


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """64-bit hashes of the shingles: each is the hash of its words' hashes, so no shingle text is built."""
    hashed = F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.aggregate(
        F.array(F.lit(0)),
        hashed,
        lambda h, _: h,
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < words, F.array(F.aggregate(h, F.lit(words).cast("long"), lambda a, x: F.xxhash64(a, x))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))),
    )


def sketch(text: Column, scale: int = SCALE, words: int = WORDS) -> Column:
    """Sorted distinct hashes below 1/scale of the (signed) range, or else the least one."""
    top = -(1 << 63) + (1 << 64) // scale
    low = lambda hs: F.array_sort(F.array_distinct(F.filter(hs, lambda h: h < top)))
    return F.aggregate(
        F.array(F.lit(0)),
        shingle_hashes(text, words),
        lambda hs, _: hs,
        lambda hs: F.when(F.exists(hs, lambda h: h < top), low(hs)).when(F.size(hs) > 0, F.array(F.array_min(hs))).otherwise(hs),
    )


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    top = -(1 << 63) + (1 << 64) // scale
    both = F.array_sort(F.array_union(a, b))
    return F.when(F.exists(both, lambda h: h < top), F.filter(both, lambda h: h < top)).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other has."""
    least = F.least(F.size(a), F.size(b))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least.cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    shared, all_of = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(all_of == 0, F.lit(1.0)).otherwise(shared / (all_of - shared).cast("double"))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def block_of(docs: DataFrame, place: Column, tie: Column, turn: Column, block: int) -> Column:
    """How many of the bounds, evenly spaced quantiles of (place, tie, turn), are at or before a row: its block.

    The bounds come from the keys alone: all of them, or about SAMPLED for each of
    MOST_BLOCKS blocks by a hash, so sparse or clustered keys make blocks of one size. `turn` is
    spread evenly over rows that are equal in the others, so these are parted too.
    """
    n = docs.count()
    blocks = max(1, min(MOST_BLOCKS, n // block))
    if blocks == 1:
        return F.lit(0)
    thin = -(-n // (SAMPLED * MOST_BLOCKS))
    keys = docs.select(place.alias("place"), tie.alias("tie"), turn.alias("turn"))
    keys = (keys.filter(F.pmod(F.xxhash64("place", "tie", "turn"), F.lit(thin)) == 0) if thin > 1 else keys).toArrow()
    places, ties, turns = (keys[c].to_numpy() for c in ("place", "tie", "turn"))
    order = np.lexsort((turns, ties, places))
    at = order[np.unique(np.arange(1, blocks) * len(order) // blocks)] if len(order) else order
    written = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    bound_place, bound_tie, bound_turn, count = written(places[at].tolist()), written(ties[at].tolist()), written(turns[at].tolist()), len(at)
    steps = [1 << i for i in reversed(range(count.bit_length()))]

    def further(found: Column, step: Column) -> Column:
        p, t, u = (F.get(bound, found + step - 1) for bound in (bound_place, bound_tie, bound_turn))
        before = (p < place) | ((p == place) & ((t < tie) | ((t == tie) & (u <= turn))))
        return F.when((found + step <= count) & F.coalesce(before, F.lit(False)), found + step).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def with_next(docs: DataFrame, key: str, value: str, derived: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Each row with `own` and `next`: structs of `value` and the `derived` columns, `next` being those of the row that follows in descending `key` order; after the last comes the first.

    One shuffle deals neighbours out in blocks; only each block's first row travels again.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(value), 1)
    # growing along the order: keys fall, null keys come after the least; `tie` is negative for the others
    place = F.coalesce(F.bitwise_not(F.col(key).cast("bigint")), F.lit((1 << 63) - 1))
    tie = F.when(F.col(key).isNull(), hashed).otherwise(-1 - hashed)
    row = F.struct(F.col(value), *(c.alias(name) for name, c in derived.items()))
    # rows that are equal in both are equal: any turn will do, as long as it parts many of them
    turned = docs.select(key, value, place.alias("_place"), tie.alias("_tie"), F.xxhash64(F.monotonically_increasing_id()).alias("_turn"))
    keys = ("_place", "_tie", "_turn")
    dealt = turned.withColumn("_block", block_of(turned, *map(F.col, keys), block))
    near = Window.partitionBy("_block").orderBy(*keys)
    out = dealt.select(key, "_block", *keys, row.alias("own")).withColumn("_next", F.lead("own").over(near))
    first = F.row_number().over(near)
    heads = dealt.withColumn("_first", first).filter(F.col("_first") == 1).select(F.col("_block").alias("_follows"), row.alias("_head"))

    # no more than MOST_BLOCKS rows
    blocks = dealt.select("_block").distinct()
    links = blocks.select("_block", F.coalesce(F.lead("_block").over(Window.orderBy("_block")), F.min("_block").over(Window.partitionBy())).alias("_follows"))
    links = links.join(heads, "_follows").select("_block", "_head")
    return out.join(links, "_block").select(key, "own", F.coalesce("_next", "_head").alias("next"))


def report(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the two fingerprints and their likeness, and the next document's."""
    own = docs.select("doc_id", whole_text().alias("text"))
    out = with_next(own, "doc_id", "text", {"hashes": sketch(F.col("text"), scale)}).withColumn("n_chars", F.length("own.text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    out = out.withColumn("edited", F.concat(F.substring(F.col("own.text"), F.lit(1), F.col("n_chars") - half), F.substring(F.col("next.text"), F.lit(1), half)))
    out = out.withColumn("edited_hashes", sketch(F.col("edited"), scale))
    mine, edited, after = F.col("own.hashes"), F.col("edited_hashes"), F.col("next.hashes")
    return out.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(mine).alias("fingerprint"),
        as_text(edited).alias("edited_fingerprint"),
        containment(mine, edited).alias("near_edited"),
        containment(mine, after).alias("near_next"),
        jaccard(mine, edited).alias("jaccard_edited"),
        jaccard(mine, after).alias("jaccard_next"),
    )
