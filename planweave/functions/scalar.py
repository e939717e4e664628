"""Scalar expressions: codes, labels, weights, schedules, compactness."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from planweave import model


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def ratio(over: Column, under: Column, empty: float) -> Column:
    """over / under, or `empty` where under is 0 or null."""
    return F.coalesce(F.when(under != 0, over / under), F.lit(empty))


def polsby_popper(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, clip01(F.lit(4 * math.pi) * area / (perimeter * perimeter))).otherwise(F.lit(0.0))


def margin(share: Column) -> Column:
    return F.bround(F.abs(share - 0.5) * 200).cast("int")


def lean_label(share: Column) -> Column:
    return F.concat(F.when(share >= 0.5, "D+").otherwise("R+"), margin(share).cast("string"))


def lean(share: Column) -> Column:
    return F.when(share >= 0.5, "D").otherwise("R")


def same_admin(a: Column, b: Column) -> Column:
    """Equal and neither null nor empty."""
    return F.coalesce((a == b) & (a != ""), F.lit(False))


def edge_weight(county: Column, place: Column, cousub: Column, road: Column, water: Column | None = None) -> Column:
    """1, times a factor for each administrative unit that the ends share, over a divisor for each barrier between them."""
    weight = F.lit(1.0)
    for same, factor in ((county, model.W_COUNTY), (place, model.W_PLACE), (cousub, model.W_COUSUB)):
        weight = weight * F.when(same, factor).otherwise(1.0)
    for barrier, divisor in ((road, model.ROAD_DIVISOR), (water, model.WATER_DIVISOR)):
        if barrier is not None:
            weight = weight / F.when(barrier, divisor).otherwise(1.0)
    return F.round(weight, 4)


def steps_for(base: int, k: Column) -> Column:
    return F.greatest(F.lit(base), F.bround(F.lit(float(base)) * k / 8).cast("int"))


def beta_for(k: Column) -> Column:
    return F.when(k <= 2, model.BETA_FEW).otherwise(model.BETA_MANY)


def zero_filled(code: Column, width: int) -> Column:
    """Leading zeros stripped, then filled up to `width`; longer codes stay whole."""
    bare = F.regexp_replace(F.trim(code), "^0+", "")
    return F.when(F.length(bare) >= width, bare).otherwise(F.lpad(bare, width, "0"))


def geoid_of(code: Column) -> Column:
    """What follows 'US', or else the last 11 characters."""
    return F.when(F.contains(code, F.lit("US")), F.element_at(F.split(code, "US"), 2)).otherwise(F.right(code, F.lit(11)))


def herfindahl(groups: Column) -> Column:
    """1 minus the summed squared shares of an array of counts, 0 where it is empty."""
    total = F.aggregate(groups, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, 1 - F.aggregate(groups, F.lit(0.0), lambda a, x: a + (x / total) * (x / total))).otherwise(F.lit(0.0))


# Stops of the diverging colour scale, share and hexadecimal colour.
STOPS = (
    (0.00, "8B0000"), (0.15, "C0152B"), (0.30, "E06060"), (0.42, "F4B8B8"), (0.48, "F9E0E0"), (0.50, "F5F0F8"),
    (0.52, "DCE8F9"), (0.58, "AACCED"), (0.70, "4A90D9"), (0.85, "1259A6"), (1.00, "003087"),
)


def colour_channel(share: Column, channel: int) -> Column:
    """Red, green or blue (0, 1, 2) of a share, 0 to 255, linear between the stops."""
    stops = [(at, int(code[2 * channel : 2 * channel + 2], 16)) for at, code in STOPS]
    out = F.lit(float(stops[-1][1]))
    for (low, start), (high, end) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(clip01(share) <= high, start + (clip01(share) - low) / (high - low) * (end - start)).otherwise(out)
    return out
