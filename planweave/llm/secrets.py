"""Secret scans: patterns plus sliding-window entropy, in DataFrame expressions only.

Three base kinds are found by pattern; the fourth, `entropy`, is a string of key-like
characters in which some window of 20 has a Shannon entropy over the threshold of
the string's character class. The entropy of all windows comes from one fold that
adds the entering character to the counts and takes the leaving one out.

The allow-list takes its parts (UUIDs, dates, placeholders, counting sequences) out
of the runs of such characters and tests what is left on either side, so a date beside
a key doesn't hide the key. Strings of digits and signs, plain words joined by signs,
letters of one case only (words run together look the same) and strings inside a base
span are not reported.

Null text counts as empty and has no spans; an empty table gives no rows; repeated
rows are each scanned. Positions are code points, ends exclusive. No pattern nests
one repetition in another and the folds' states don't grow, so a text may be of any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

KINDS = ("assign", "access", "hex", "entropy")
# The three base patterns. A failing match consumes its text, so only
# where shorter matches can't hide longer ones is the least length in the pattern.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
WINDOW = 20
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits per character that some window of a run must reach, by the run's character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "letters": 4.0, "signs": 3.8}
#: What is taken out of a run before it is tested.
ALLOWED_PARTS = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|(?i:example|placeholder|changeme|your[_-]?(?:key|token|secret)|xxxx|0123456789|abcdefghij)"
)
SIGNS = r"[/_+=-]+"
#: Strings that are of a base kind as a whole, or of digits and signs.
NOT_TESTED = r"^(?:[0-9a-f]+|AKIA[A-Z0-9]{14,}|[0-9=_/+-]+)$"
#: Spans that one fold gathers; the next begins where it ended.
CHUNK = 256
SPANS = "array<struct<start:int,rank:int,end:int,found:string>>"


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once."""
    return F.aggregate(F.array(F.lit(0)), value, lambda held, _: held, body)


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start,rank,end,found>> of the leftmost non-overlapping matches.

    The pieces between matches and the matches alternate, so their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("found"), tested.alias("tested"))
    fits = (lambda part: F.length(part["tested"]) >= least) if least else None
    spans = _let(parts, lambda parts: _placed(parts, kind, fits))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def _placed(parts: Column, kind: str, fits=None) -> Column:
    """The spans of alternating gaps and found strings, of those that `fits` takes.

    They are folded CHUNK at a time and the chunks shifted by what went before, so long
    lists aren't copied span by span.
    """
    rank = KINDS.index(kind)

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["gap"]
        end = start + F.length(part["found"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), part["found"].alias("found"))
        more = F.concat(acc["kept"], F.array(span))
        return F.struct(end.alias("at"), (F.when(fits(part), more).otherwise(acc["kept"]) if fits else more).alias("kept"))

    init = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("kept"))
    last = F.floor((F.size(parts) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.aggregate(F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)), init, step))

    def joined(chunks: Column) -> Column:
        begins = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])))
        shifted = F.zip_with(chunks, F.slice(begins, F.lit(1), F.size(chunks)), lambda c, by: F.transform(c["kept"], lambda s: _shifted(s, by)))
        return F.flatten(shifted)

    return F.when(F.size(parts) <= CHUNK, F.aggregate(parts, init, step, lambda acc: acc["kept"])).otherwise(_let(chunks, joined))


def _shifted(span: Column, by: Column) -> Column:
    return F.struct((span["start"] + by).alias("start"), span["rank"].alias("rank"), (span["end"] + by).alias("end"), span["found"].alias("found"))


#: Bits of a character's count, and characters whose counts share a number.
COUNT_BITS, SHARED = 5, 12


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits a character) of any `window` (31 at most) neighbouring characters of `run`.

    The counts of all characters are held in a few numbers, so a step costs the same in a run of any length.
    """
    weigh = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    held = [f"c{i}" for i in range(-(-(len(ALPHABET) + 1) // SHARED))]
    one = lambda code, i: F.when(F.floor(code / SHARED) == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), (code % SHARED * COUNT_BITS).cast("int"))).otherwise(F.lit(0).cast("bigint"))

    def count(acc: Column, code: Column) -> Column:
        number = F.get(F.array(*(acc[c] for c in held)), F.floor(code / SHARED).cast("int"))
        return F.call_function("shiftright", number, (code % SHARED * COUNT_BITS).cast("int")).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def step(acc: Column, pair: Column) -> Column:
        enters, leaves = pair["enters"], pair["leaves"]
        full = leaves.isNotNull()
        n_in, n_out = count(acc, enters), count(acc, leaves)
        gained = F.get(weigh, n_in + 1) - F.get(weigh, n_in)
        lost = F.when(full, F.get(weigh, n_out - 1) - F.get(weigh, n_out)).otherwise(F.lit(0.0))
        same = full & (enters == leaves)
        total = F.when(same, acc["total"]).otherwise(acc["total"] + gained + lost)
        counts = [F.when(same, acc[c]).otherwise(acc[c] + one(enters, i) - F.when(full, one(leaves, i)).otherwise(F.lit(0).cast("bigint"))).alias(c) for i, c in enumerate(held)]
        return F.struct(*counts, total.alias("total"), F.when(full, F.least(acc["least"], acc["total"])).otherwise(acc["least"]).alias("least"))

    codes = F.transform(F.split(run, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    pairs = _let(codes, lambda codes: F.arrays_zip(codes.alias("enters"), F.concat(F.array_repeat(F.lit(None).cast("int"), window), F.slice(codes, F.lit(1), F.size(codes) - window)).alias("leaves")))
    init = F.struct(*(F.lit(0).cast("bigint").alias(c) for c in held), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))
    fold = F.aggregate(pairs, init, step, lambda acc: F.lit(math.log2(window)) - F.least(acc["least"], acc["total"]) / window)
    return F.when(F.length(run) >= window, fold).otherwise(F.lit(0.0))


def _threshold(run: Column) -> Column:
    """The entropy that a window of `run` needs; null for those that aren't tested."""
    mixed = run.rlike("[a-z]") & run.rlike("[A-Z]")
    return (
        F.when(run.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(THRESHOLDS["hex"]))
        .when(run.rlike("^[A-Za-z]+$"), F.when(mixed, F.lit(THRESHOLDS["letters"])))
        .when(run.rlike("^[A-Za-z0-9]+$"), F.lit(THRESHOLDS["alnum"]))
        .when(mixed | run.rlike("[0-9]"), F.lit(THRESHOLDS["signs"]))
    )


def _plain_words(run: Column) -> Column:
    """Words joined by signs, the last with up to four digits."""
    words = F.filter(F.split(run, SIGNS), lambda w: w != "")
    first = F.forall(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.rlike("^[A-Za-z]?[a-z]*$"))
    return first & F.coalesce(F.try_element_at(words, F.lit(-1)).rlike("^[A-Za-z]?[a-z]*[0-9]{0,4}$"), F.lit(True))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(_spans(text, ASSIGN, "assign", 2, ASSIGN_LEAST), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def candidates(text: Column) -> Column:
    """What the allowed parts leave of the runs of key-like characters, where it is a window long."""

    def left(run: Column) -> Column:
        whole = F.array(run)
        pieces = F.split(run["found"], ALLOWED_PARTS, -1)
        parts = F.regexp_extract_all(run["found"], F.lit(ALLOWED_PARTS), F.lit(0))
        # gaps and found strings change places: what lies between the allowed parts is sought
        zipped = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(parts, F.length)).alias("gap"), pieces.alias("found"))
        cut = _let(zipped, lambda z: F.transform(_placed(z, "entropy", lambda p: F.length(p["found"]) >= WINDOW), lambda s: _shifted(s, run["start"])))
        return F.when(run["found"].rlike(ALLOWED_PARTS), cut).otherwise(whole)

    return F.flatten(F.transform(_spans(text, RUN, "entropy"), left))


def entropy_spans(text: Column, base: Column) -> Column:
    def wanted(run: Column) -> Column:
        found = run["found"]
        inside = lambda: F.exists(base, lambda b: (b["start"] <= run["start"]) & (b["end"] >= run["end"]))
        # the cheap tests first: a condition's later parts are evaluated only where the earlier ones hold
        return F.when(found.rlike(NOT_TESTED) | _threshold(found).isNull() | _plain_words(found), F.lit(False)).when(window_entropy(found) < _threshold(found), F.lit(False)).otherwise(~inside())

    return F.filter(candidates(text), wanted)


def scan(docs: DataFrame, text: str = "text", into: str = "found") -> DataFrame:
    """`docs` with `into`: array<struct<start,rank,end,found>>, by start, then kind as listed, and `<into>_base` without the entropy spans."""
    base = f"{into}_base"
    return docs.withColumn(base, base_spans(whole_text(text))).withColumn(into, F.array_sort(F.concat(F.col(base), entropy_spans(whole_text(text), F.col(base)))))


def digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every span (overlaps taken together) replaced by `mark`."""

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        more = F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, more).otherwise(acc["done"]).alias("done"))

    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, init, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text)))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans."""
    out = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter(F.col("found"), lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, KINDS[:3]), F.sha2(digest(F.col("found_base")), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"), count("entropy"))
