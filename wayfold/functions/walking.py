"""Walking costs, scaled paces and their rounding; each rounding mode is part of the semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clamp of the slope, factor of stairs, pace of the baked walks (km/h) and the presets.
SLOPE_CLAMP, STAIRS = 0.5, 2.5
BAKED_KMH, PRESETS_KMH = 4.8, {"slow": 3.4, "med": 4.2, "fast": 5.2}


def tobler(slope: Column) -> Column:
    """Slowdown of a slope against the flat: exp(3.5 (|s + 0.05| - 0.05))."""
    s = F.greatest(F.lit(-SLOPE_CLAMP), F.least(F.lit(SLOPE_CLAMP), slope))
    return F.exp(3.5 * (F.abs(s + 0.05) - 0.05))


def edge_seconds(length_m: Column, slope: Column, stairs: Column, kmh: float = BAKED_KMH) -> Column:
    return length_m / (kmh / 3.6) * tobler(slope) * F.when(stairs, STAIRS).otherwise(1.0)


def scaled_rint(seconds: Column, factor: float) -> Column:
    """A walk at another pace, to the nearest second, halves to even; -1 (no walk) stays."""
    return F.when(seconds < 0, seconds).otherwise(F.rint(seconds * F.lit(factor)).cast("long"))


def scaled_transfer(walk: Column, least: Column, factor: float, pathway: Column) -> Column:
    """Only the walk of a transfer scales, and not that of a pathway; the minimum holds; halves go up."""
    own = F.when(pathway, walk).otherwise(walk * F.lit(factor))
    return F.floor(F.greatest(own, least) + 0.5).cast("long")


def scaled_never_zero(seconds: Column, factor: float) -> Column:
    """The older transfer rule: a positive walk never rounds below one second."""
    return F.when(seconds > 0, F.greatest(F.rint(seconds * F.lit(factor)).cast("long"), F.lit(1))).otherwise(seconds)


def minutes_up(seconds: Column) -> Column:
    return F.ceil(seconds / 60).cast("long")


def octant(dx: Column, dy: Column, sectors: int = 8) -> Column:
    """The compass sector of a direction, halves to even, east being 0."""
    return F.pmod(F.bround(F.degrees(F.atan2(dy, dx)) / F.lit(360.0 / sectors)), F.lit(sectors)).cast("long")
