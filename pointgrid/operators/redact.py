"""Blurring rectangles out of panoramas and writing the result back to points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.colour import saturate
from ..stages import grown, measured

# Fixed values of the blur.
KERNEL_BASE, KERNEL_GROWTH = 13, 6.0
SIGMA = 4.0 * math.e


def _kernel(pos: Column, start: Column, length: Column) -> Column:
    """Odd kernel width, growing from the rectangle's edge to its middle."""
    half = F.floor(length / 2)
    grow = (half - F.abs(pos - (start + half))) / KERNEL_GROWTH
    return G.trunc(F.lit(KERNEL_BASE) + grow).bitwiseOR(F.lit(1))


def _taps(rects: DataFrame, start: str, length: str, pos: str, src: str, weight: str, size: int) -> DataFrame:
    """Per target position inside the rectangle: source positions and weights.

    Positions outside the image reflect to the other side of the target.
    """
    t = rects.where(F.col(length) > 0).withColumn(pos, F.explode(F.sequence(F.col(start), F.col(start) + F.col(length) - 1)))
    t = t.where(F.col(pos).between(0, size - 1))
    half = F.floor(_kernel(F.col(pos), F.col(start), F.col(length)) / 2).cast("int")
    t = t.withColumn("_d", F.explode(F.sequence(-half - F.lit(0), half - 1)))
    at = F.col(pos) + F.col("_d")
    t = t.withColumn(src, F.when((at < 0) | (at >= size), F.col(pos) - F.col("_d")).otherwise(at))
    off = F.col(src) - F.col(pos)
    return t.withColumn(weight, F.exp(-(off * off) / (2.0 * SIGMA * SIGMA))).drop("_d")


def redact(image: DataFrame, rects: DataFrame, rows: int, cols: int, channels: list[str]) -> DataFrame:
    """Blurred colours of every pixel inside a rectangle.

    ``image`` is ``(scan_id, row, col, channels)``; ``rects`` is ``(rect_id, scan_id, x, y,
    width, height)`` as fractions. The Gaussian and its varying kernel are separable, so
    a row pass and a column pass replace the two-dimensional window. Later rectangles
    overwrite earlier ones; the blur always reads the original image, so of rectangles on the same
    pixels only the last is blurred. Runs a job.
    """
    x, y, w, h = G.rect_pixels(*[F.col(c) for c in ("x", "y", "width", "height")], cols, rows)
    px = rects.select("rect_id", "scan_id", x.alias("x0"), y.alias("y0"), w.alias("w"), h.alias("h"))
    px = measured(px.groupBy("scan_id", "x0", "y0", "w", "h").agg(F.max("rect_id").alias("rect_id")))
    across = _taps(px.select("rect_id", "scan_id", "x0", "w"), "x0", "w", "col", "src_col", "wx", cols)
    down = _taps(px.select("rect_id", "scan_id", "y0", "h"), "y0", "h", "row", "src_row", "wy", rows)
    needed = down.select("rect_id", "scan_id", "src_row").distinct()
    src = grown(needed).join(image.select("scan_id", F.col("row").alias("src_row"), F.col("col").alias("src_col"), *channels),
                      ["scan_id", "src_row"])
    part = src.join(grown(across.select("rect_id", "scan_id", "col", "src_col", "wx")), ["rect_id", "scan_id", "src_col"]).groupBy(
        "rect_id", "scan_id", "src_row", "col").agg(*[F.sum(F.col("wx") * F.col(c)).alias(c) for c in channels], F.sum("wx").alias("wx"))
    full = part.join(grown(down.select("rect_id", "scan_id", "row", "src_row", "wy")), ["rect_id", "scan_id", "src_row"]).groupBy(
        "rect_id", "scan_id", "row", "col").agg(
        *[(F.sum(F.col("wy") * F.col(c)) / F.sum(F.col("wy") * F.col("wx"))).alias(c) for c in channels])
    last = F.max_by(F.struct(*channels), "rect_id").alias("v")
    return full.groupBy("scan_id", "row", "col").agg(last).select("scan_id", "row", "col", "v.*")


def write_back(points: DataFrame, blurred: DataFrame, rows, cols) -> DataFrame:
    """Points with the blurred colour of their panorama pixel, others unchanged."""
    row, col = G.scan_order_to_rc(F.col("idx"), rows, cols)
    flipped = (cols if isinstance(cols, Column) else F.lit(cols)) - col - 1
    p = points.withColumn("row", row).withColumn("col", flipped)
    new = blurred.select("scan_id", "row", "col", *[saturate(F.col(c)).cast("short").alias(f"_{c}") for c in "rgb"])
    out = p.join(new, ["scan_id", "row", "col"], "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in ("r", "g", "b") else F.col(c) for c in points.columns])
