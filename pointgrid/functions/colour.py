"""Grey levels of evidence images and the heat colour ramp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def saturate(c: Column) -> Column:
    """Round half to even, clip to a byte."""
    return F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(255.0)).cast("int")


def point_grey(count: Column, mean: Column, sigma: Column) -> Column:
    """Dark where many slabs are occupied: one sigma above the mean starts to darken."""
    s = F.nullif(sigma, F.lit(0.0))
    return 255 - saturate((count - mean - sigma) / (s * 3.0) * 255.0)


def free_grey(count: Column, mean: Column, sigma: Column) -> Column:
    s = F.nullif(sigma, F.lit(0.0))
    return 255 - saturate(((count - mean) / s + 1.0) * 255.0)


def heat_rgb(z: Column) -> Column:
    """Blue-green-red ramp of a z-score."""
    grey = saturate((z + 1.0) / 2.0 * 255.0)
    low = grey < 128
    red = F.when(low, 0).otherwise((grey - 128) * 2)
    green = F.when(low, grey * 2).otherwise(255 - (grey - 128) * 2)
    blue = F.when(low, 255 - grey * 2).otherwise(0)
    return F.struct(red.alias("r"), green.alias("g"), blue.alias("b"))
