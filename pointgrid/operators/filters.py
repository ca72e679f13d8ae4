"""Row predicates on points, normals, cells, candidates and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..stages import measured

MIN_INTENSITY = 0.01
AXES = ("x", "y", "z")


def valid_returns(points: DataFrame) -> DataFrame:
    """Drop empty returns and those too dark to trust."""
    some = (F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0)
    return points.where(some & (F.col("intensity") >= MIN_INTENSITY))


def outside_radius(points: DataFrame, r: float = 1.0) -> DataFrame:
    return points.where(F.col("x") * F.col("x") + F.col("y") * F.col("y") > r * r)


def sigma_box(stats: DataFrame, ranges: tuple[float, float, float]) -> DataFrame:
    """Box limits ``x0..z1`` from per-scan means and deviations."""
    cols = [c for c in stats.columns if not c.startswith(("mean_", "sigma_"))]
    limits = []
    for a, rng in zip(AXES, ranges):
        half = F.col(f"sigma_{a}") * rng * 1.1 / 2.0
        limits += [(F.col(f"mean_{a}") - half).alias(f"{a}0"), (F.col(f"mean_{a}") + half).alias(f"{a}1")]
    return stats.select(*cols, *limits)


def in_box(points: DataFrame, box: DataFrame, by: list[str], min_intensity: float | None = None) -> DataFrame:
    """Points inside their scan's box, limits included."""
    keep = F.lit(True)
    for a in AXES:
        keep = keep & F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1"))
    if min_intensity is not None:
        keep = keep & (F.col("intensity") >= min_intensity)
    return points.join(measured(box), by).where(keep).select(*[points[c] for c in points.columns])


def finite_normals(df: DataFrame) -> DataFrame:
    bad = F.lit(False)
    for n in ("nx", "ny", "nz"):
        bad = bad | F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    return df.where(~bad)


def perpendicular_to(normals: DataFrame, axis: G.Vec, tol: float = 0.02) -> DataFrame:
    """Normals within ``tol`` of a right angle to ``axis``."""
    sine = G.norm(G.cross(G.vec("n"), axis))
    return normals.where(F.asin(G.unit_clamp(sine)) > F.pi() / 2.0 - tol)


def confident(cells: DataFrame, threshold: float) -> DataFrame:
    return cells.where(F.col("value") > threshold)


def valid_keypoints(keypoints: DataFrame, pano_cells: DataFrame) -> DataFrame:
    """Keypoints on a cell with a depth and a normal."""
    solid = pano_cells.where(
        (F.col("depth") != 0) & ((F.col("nx") != 0) | (F.col("ny") != 0) | (F.col("nz") != 0))
    ).select("scan_id", "row", "col")
    kp = keypoints.withColumn("row", G.trunc(F.col("y"))).withColumn("col", G.trunc(F.col("x")))
    return kp.join(solid, ["scan_id", "row", "col"], "left_semi").select(*keypoints.columns)


def scored(df: DataFrame) -> DataFrame:
    """Drop candidates without a finite score (NULL, NaN or the -1 marker)."""
    s = F.col("score")
    return df.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")) & (F.abs(s + 1.0) >= 1e-12))


def accept_below(df: DataFrame, k: float = 1.2) -> DataFrame:
    """Scores clearly better than the average of all."""
    limit = df.agg((F.avg("score") - F.stddev_samp("score") * k).alias("limit")).scalar()
    return df.where(F.col("score") < limit)


def drop_outliers(df: DataFrame, value: str, by: list[str], k: float = 1.0) -> DataFrame:
    """Keep values within ``k`` deviations of their group's mean."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    keep = F.abs(F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)) <= k
    return df.join(measured(stats), by).where(keep).select(*[df[c] for c in df.columns])


def threshold_voxels(voxels: DataFrame, stats: DataFrame, by: list[str], k: float = -1.0) -> DataFrame:
    """Voxels whose count is not far below average. ``stats`` always come from the
    point voxels, also when free-space voxels are filtered."""
    z = (F.col("n") - F.col("mean_n")) / F.nullif(F.col("sigma_n"), F.lit(0.0))
    return voxels.join(measured(stats), by).where(z > k).select(*[voxels[c] for c in voxels.columns])


def clip(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Keep rows with low <= column < high for every listed column."""
    keep = F.lit(True)
    for name, (low, high) in bounds.items():
        keep = keep & (F.col(name) >= low) & (F.col(name) < high)
    return df.where(keep)


def gate_candidates(cands: DataFrame, min_inside: float = 0.7, min_mass: float = 0.6) -> DataFrame:
    """Enough of the mask inside the plan, and enough plan mass under the mask.

    Needs columns ``n_inside``, ``n_mask``, ``plan_mass`` and ``scan_mass``.
    """
    return cands.where(
        (F.col("n_inside") >= F.col("n_mask") * min_inside)
        & (F.col("plan_mass") >= F.col("scan_mass") * min_mass)
    )


def keep_edges(edges: DataFrame, sig: float = 0.05, w: float = 0.05) -> DataFrame:
    return edges.where((F.col("w_sig") >= sig) & (F.abs("w") >= w))


def pano_edge(sig: Column, score: Column, cut: float = 0.05) -> Column:
    """Panorama evidence counts only with enough matches and a finite score."""
    return (sig >= cut) & score.isNotNull() & ~F.isnan(score)


def not_white(df: DataFrame, means: list[str], limit: float = 240.0) -> DataFrame:
    """Drop patches that are near white in every channel."""
    white = F.lit(True)
    for m in means:
        white = white & (F.col(m) > limit)
    return df.where(~white)
