"""Numeric expressions: gates, bands and rescaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import fixed


def in_band(ratio: Column, low: float = fixed.WIDTH_BAND[0], high: float = fixed.WIDTH_BAND[1]) -> Column:
    """Half-open band; an unmeasured ratio passes."""
    return F.coalesce((ratio >= low) & (ratio < high), F.lit(True))


def rescale_unit(v: Column) -> Column:
    """Array in [-1, 1], [0, 1] or [0, 255] to integers 0..255, the range told from its ends."""
    low, high = F.array_min(v), F.array_max(v)

    def shade(x: Column) -> Column:
        scaled = F.when(low < -0.01, (x + 1.0) / 2.0).when(high > 1.01, x / 255.0).otherwise(x)
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)) * 255.0).cast("int")

    return F.transform(v, shade)


def separates(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """True where two intervals share no point."""
    return (a_high < b_low) | (b_high < a_low)


def half_width(low: Column, high: Column) -> Column:
    return (high - low) / 2.0
