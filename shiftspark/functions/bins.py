"""Binning of a value on an evenly divided range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftspark.functions.stats import d


def bin_edge(start: Column, stop: Column, bins: int, i: Column) -> Column:
    """Lower edge of bin i of the range start..stop; i = bins is the upper end."""
    return start + i.cast("double") * ((stop - start) / d(bins))


def bin_of(v: Column, start: Column, stop: Column, bins: int) -> Column:
    """0-based bin of v on start..stop, the last bin closed.

    The quotient may land one bin off next to an edge, so it is checked
    against the edges themselves."""
    width = (stop - start) / d(bins)
    g = F.least(F.floor(F.try_divide(v - start, width)), F.lit(bins - 1)).cast("int")
    low, high = bin_edge(start, stop, bins, g), bin_edge(start, stop, bins, g + 1)
    return (
        F.when(stop == start, F.lit(0))
        .when((g > 0) & (v < low), g - 1)
        .when((g < bins - 1) & (v >= high), g + 1)
        .otherwise(g)
    )
