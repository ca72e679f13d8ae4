"""Merging placed scans into one cleaned cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import filters, merging, neighbors, stats
from ..stages import cut, measured, new_stage_path

# Fixed values of the merge.
START_LEAF, FIRST_LEAF_SHARE, PLAIN_LEAF = 0.02, 0.85, 0.005
KEEP_BOX, TARGET_BOX = (3.5, 3.5, 4.0), (3.0, 3.0, 3.0)
TARGET_SHARE = 0.25
FEATURE_LEAF, NORMAL_NEIGHBOURS = 0.04, 30
# Floor tiles that tell scans apart, and blocks in which the cloud is stored, in metres.
TILE, BLOCK = 1.0, 16.0


def pose_transforms(poses: DataFrame) -> DataFrame:
    """4x4 transform of every placed scan."""
    return poses.where(F.col("rot").isNotNull()).select("scan_id", G.pose_matrix(F.col("rot"), F.col("t")).alias("m"))


def prepare_scans(points: DataFrame, transforms: DataFrame, leaf: float = START_LEAF) -> tuple[DataFrame, DataFrame]:
    """Transformed, thinned and boxed scans, and the box each is refined in."""
    moved = merging.apply_transforms(points, transforms)
    thin = neighbors.uniform_sample(moved, leaf * FIRST_LEAF_SHARE, ["scan_id"])
    box = filters.sigma_box(stats.box_stats(thin, ["scan_id"]), KEEP_BOX)
    kept = neighbors.uniform_sample(filters.in_box(thin, box, ["scan_id"]), leaf, ["scan_id"])
    target = filters.sigma_box(stats.box_stats(kept, ["scan_id"]), TARGET_BOX)
    return kept, target


def finish(cloud: DataFrame, leaf: float, limit: float | None, k: int, m: float) -> DataFrame:
    """Sample the union (with a ``limit`` again with a larger leaf when more points remain) and drop outliers."""
    cloud = cloud.withColumn("idx", F.struct("scan_id", "idx")) if "scan_id" in cloud.columns else cloud
    thin = neighbors.uniform_sample(cloud, leaf, [], "idx") if limit is None else neighbors.sample_to(cloud, leaf, limit)
    thin = cut(thin, "merged")
    return neighbors.drop_statistical_outliers(thin, k, m, [])


def merge_with_transforms(points: DataFrame, transforms: DataFrame, leaf: float = PLAIN_LEAF, limit: float | None = None,
                          k: int = 50, m: float = 2.0) -> DataFrame:
    """Merge with given transforms only. ``idx`` becomes ``(scan_id, idx)``. Runs jobs."""
    return finish(merging.apply_transforms(points, transforms), leaf, limit, k, m)


def waves(spans: DataFrame, tile: float = TILE) -> DataFrame:
    """``scan_id, wave``: scans that can be aligned together without changing what a walk in scan order gives.

    ``spans`` is ``scan_id, x0, x1, y0, y1``, the floor area a scan reads or writes. A scan is ready when
    no earlier scan that is not done shares a tile with it. Runs jobs; as many rounds as there are waves.
    """
    cells = lambda a: F.explode(F.sequence(F.floor(F.col(f"{a}0") / tile), F.floor(F.col(f"{a}1") / tile)))
    left = cut(spans.withColumn("tx", cells("x")).withColumn("ty", cells("y")).select("scan_id", "tx", "ty"), "tiles")
    out, wave = None, 0
    while True:
        first = left.groupBy("tx", "ty").agg(F.min("scan_id").alias("_first"))
        late = left.join(first, ["tx", "ty"]).groupBy("scan_id").agg(F.max(F.col("scan_id") > F.col("_first")).alias("_late"))
        ready = cut(late.where("NOT _late").select("scan_id", F.lit(wave).alias("wave")), "waves")
        out = ready if out is None else out.unionByName(ready)
        left = cut(left.join(ready, "scan_id", "left_anti"), "tiles")
        if left.isEmpty():
            return out
        wave += 1


def reach_of(kept: DataFrame, boxes: DataFrame) -> DataFrame:
    """Floor area of every scan: its points wherever a small motion may take them, and its target box with a tile around."""
    far = F.lit(0.2) + 0.05 * sum((F.greatest(F.abs(F.min(a)), F.abs(F.max(a))) for a in "xyz"), F.lit(0.0))
    own = kept.groupBy("scan_id").agg(far.alias("_s"), *[f(a).alias(f"_{a}{i}") for a in "xy" for i, f in enumerate((F.min, F.max))])
    both = own.join(boxes, "scan_id")
    low = [F.least(F.col(f"_{a}0") - F.col("_s"), F.col(f"{a}0") - TILE).alias(f"{a}0") for a in "xy"]
    high = [F.greatest(F.col(f"_{a}1") + F.col("_s"), F.col(f"{a}1") + TILE).alias(f"{a}1") for a in "xy"]
    return both.select("scan_id", *low, *high)


def with_curvature(sample: DataFrame, surface: DataFrame) -> DataFrame:
    """Sampled points with the curvature of the surface around them, as refinement compares them."""
    normal = neighbors.normals_knn(sample, surface, NORMAL_NEIGHBOURS, ["scan_id"])
    return normal.select("scan_id", "idx", "x", "y", "z", "curvature")


def store_blocks(points: DataFrame, name: str) -> DataFrame:
    """Store points by blocks of the floor, so that a region is read without the rest."""
    path = new_stage_path(points.sparkSession, name)
    block = [F.floor(F.col(a) / BLOCK).cast("int").alias(f"b{a}") for a in "xy"]
    points.select("*", *block).repartition("bx", "by").write.partitionBy("bx", "by").parquet(path)
    return points.sparkSession.read.schema(points.select("*", *block).schema).parquet(path)


def in_blocks(stored: list[DataFrame], region: DataFrame) -> DataFrame:
    """The stored points in the blocks that the regions touch."""
    cells = lambda a: F.explode(F.sequence(F.floor(F.col(f"{a}0") / BLOCK), F.floor(F.col(f"{a}1") / BLOCK)))
    rows = region.withColumn("bx", cells("x")).withColumn("by", cells("y")).select("bx", "by").distinct().collect()
    by_x: dict[int, list[int]] = {}
    for r in rows:
        by_x.setdefault(int(r["bx"]), []).append(int(r["by"]))
    wanted = F.lit(False)
    for x, ys in sorted(by_x.items()):
        wanted = wanted | ((F.col("bx") == x) & F.col("by").isin(sorted(ys)))
    return merging.union_clouds(*[s.where(wanted).drop("bx", "by") for s in stored])


def align_wave(mine: DataFrame, boxes: DataFrame, stored: list[DataFrame], leaf: float, rounds: int) -> DataFrame:
    """Motions ``scan_id, m, ok`` of the scans that find enough of the merged cloud in their box. Runs jobs."""
    near = in_blocks(stored, boxes.select("scan_id", *[(F.col(f"{a}{i}") + (TILE if i else -TILE)).alias(f"{a}{i}") for a in "xy" for i in (0, 1)]))
    cloud = neighbors.uniform_sample(near.drop("scan_id"), leaf, [], "idx")
    target = cut(neighbors.points_in_box(cloud, boxes, ["scan_id"]), "target")
    size = lambda df, n: df.groupBy("scan_id").agg(F.count("*").alias(n))
    enough = measured(size(target, "_t").join(size(mine, "_m"), "scan_id").where(F.col("_t") > F.col("_m") * TARGET_SHARE).select("scan_id"))
    mine, target = mine.join(enough, "scan_id", "left_semi"), target.join(enough, "scan_id", "left_semi")
    feature = lambda df: cut(with_curvature(neighbors.uniform_sample(df, FEATURE_LEAF, ["scan_id"]), df), "features")
    return cut(neighbors.refine(feature(mine), feature(target), ["scan_id"], rounds, features=["curvature"]), "motions")


def merge_scans(points: DataFrame, poses: DataFrame, refine: bool = False, leaf: float = START_LEAF,
                limit: float | None = None, k: int = 50, m: float = 2.0, rounds: int = 30) -> tuple[DataFrame, DataFrame]:
    """Merged cloud and the transforms ``(scan_id, before, after)``. Runs jobs.

    Without refinement all scans are handled in one pass. With it, each scan is aligned to the cloud of
    the scans before it when enough of that cloud lies in its box. Scans are taken in ``waves``: all that
    share no floor with an earlier scan that is not done are aligned at once, which gives what a walk in
    scan order gives, since a leaf keeps the same point however its points are merged. Points are stored by
    blocks of the floor and written once; a wave reads the blocks it touches. With a ``limit`` the leaf
    grows after the wave that exceeds it, and the cloud is thinned then.
    """
    before = cut(pose_transforms(poses), "poses")
    kept, boxes = prepare_scans(points, before, leaf)
    if not refine:
        return finish(kept, leaf, limit, k, m), before.select("scan_id", F.col("m").alias("before"), F.col("m").alias("after"))
    kept, boxes = cut(kept, "kept"), cut(boxes, "boxes")
    order = cut(waves(reach_of(kept, boxes)), "waves")
    stored: list[DataFrame] = []
    motions = None
    for wave in range((order.agg(F.max("wave")).first()[0] or 0) + 1):
        ready = measured(order.where(F.col("wave") == wave).select("scan_id"))
        mine = kept.join(ready, "scan_id", "left_semi")
        if stored:
            fit = align_wave(mine, boxes.join(ready, "scan_id", "left_semi"), stored, leaf, rounds)
            motions = fit if motions is None else motions.unionByName(fit)
            moved = mine.join(fit, "scan_id", "left_anti").unionByName(merging.apply_transforms(mine, fit))
        else:
            moved = mine
        stored.append(store_blocks(moved.withColumn("idx", F.struct("scan_id", "idx")), "cloud"))
        if limit is not None:
            thin = neighbors.uniform_sample(merging.union_clouds(*stored).drop("bx", "by"), leaf, [], "idx")
            n = thin.count()
            if n > limit:
                stored, leaf = [store_blocks(thin, "cloud")], neighbors.adaptive_leaf(n, leaf, limit)
    thin = cut(neighbors.uniform_sample(merging.union_clouds(*stored).drop("bx", "by"), leaf, [], "idx"), "merged")
    after = before.select("scan_id", F.col("m").alias("before"), F.col("m").alias("after"))
    if motions is not None:
        turned = before.join(motions.select("scan_id", F.col("m").alias("_f")), "scan_id", "left")
        after = turned.select("scan_id", F.col("m").alias("before"), F.when(F.col("_f").isNull(), F.col("m")).otherwise(G.multiply(F.col("_f"), F.col("m"), 4)).alias("after"))
    return neighbors.drop_statistical_outliers(thin, k, m, []), after
