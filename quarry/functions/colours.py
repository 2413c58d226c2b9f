"""Colours of cells by theme."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard theme's colours by number; any other number is white.
THEME = ("FFFFFF", "000000", "E7E6E6", "44546A", "4472C4", "ED7D31", "A5A5A5", "FFC000", "5B9BD5", "70AD47")
OTHER = "FFFFFF"


def theme_colour(number: Column, tint: Column, theme: tuple[str, ...] = THEME) -> Column:
    """A theme's colour by number (from 0), lighter by a tint above 0 and darker by one below, as six hex digits; a null tint changes nothing."""
    base = F.coalesce(F.get(F.array(*map(F.lit, theme)), F.when(number >= 0, number)), F.lit(OTHER))

    def channel(at: int) -> Column:
        value = F.conv(F.substring(base, at, 2), 16, 10).cast("int")
        by = F.coalesce(tint, F.lit(0.0))
        moved = F.when(by > 0, value + (255 - value) * by).when(by < 0, value * (1 + by)).otherwise(value).cast("int")
        return F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), moved)).cast("long")), 2, "0")

    return F.concat(channel(1), channel(3), channel(5))
