"""Scalar weights and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring model.
SCAN_WEIGHT, PLAN_WEIGHT, DOOR_WEIGHT = 1.5, 1.0, 0.75
FLOOR_RANGE, FLOOR_DEFAULT = (-1.7, -1.5), -1.6
DISTANCE_RANGE = (0.25, 1.5)
PATCH_STEP = 2.0 ** (1.0 / 3.0)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sigmoid_weight(seen: Column, expected: Column) -> Column:
    return 1.0 / (1.0 + F.exp((seen / F.nullif(expected, F.lit(0.0)) - 0.5) * -10.0))


def gaussian_weight(x: Column, y: Column, sx: float, sy: float) -> Column:
    return F.exp(-(x * x / (2.0 * sx * sx) + y * y / (2.0 * sy * sy)))


def clamped_norm(v: Column, mean: Column, sigma: Column) -> Column:
    return clamp((v - mean) / sigma, -1.0, 2.5)


def edge_weight(w, w_sig, pano_w, pano_sig, distance, h_weight) -> Column:
    return (w * w_sig * 0.5 + pano_w * pano_sig) * clamp(distance, *DISTANCE_RANGE) + h_weight


def placement_score(scan_fp, scan_px, fp_scan, fp_px, door_uxp, door_count) -> Column:
    """Share of scan, plan and door evidence left unexplained; NULL where undefined."""
    zero = F.lit(0.0)
    total = (
        scan_fp / F.nullif(scan_px, zero) * SCAN_WEIGHT
        + fp_scan / F.nullif(fp_px, zero) * PLAN_WEIGHT
        + door_uxp / F.nullif(door_count, zero) * DOOR_WEIGHT
    )
    return total / (SCAN_WEIGHT + PLAN_WEIGHT + DOOR_WEIGHT)


def node_weight(score: Column) -> Column:
    return 1.0 - score


def repair_floor(z: Column) -> Column:
    return F.when((z > FLOOR_RANGE[1]) | (z < FLOOR_RANGE[0]), F.lit(FLOOR_DEFAULT)).otherwise(z)


def patch_level(radius: Column, other: Column) -> Column:
    """Pyramid level at which a patch seen from ``other`` matches one seen from ``radius``."""
    steps = F.round(F.log(other / radius) / math.log(PATCH_STEP))
    return F.greatest(F.lit(0.0), steps).cast("int")
