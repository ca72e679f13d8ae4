"""Union, transform and box steps of cloud merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..stages import measured


def union_clouds(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def apply_transforms(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """Points moved by their scan's 4x4 transform; scans without one drop out. Runs a job."""
    p = points.join(measured(transforms.select("scan_id", F.col("m").alias("_m"))), "scan_id")
    moved = G.transform4(G.vec(), F.col("_m"))
    new = dict(zip("xyz", moved))
    return p.select(*[new[c].alias(c) if c in new else F.col(c) for c in points.columns])


def pair_by_scan(transforms: DataFrame, points: DataFrame) -> DataFrame:
    """Point files and transforms that belong together, matched by scan id."""
    return points.join(transforms, "scan_id")
