"""Sampling, radius and k-nearest neighbours, rigid refinement.

Neighbour search buckets space into cubes and equi-joins each query with the cubes
around it. Copies of one position are collapsed to a row with a weight first, so
stacked duplicates cost one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions import geometry as G
from ..stages import BUNCH, blocks, bunched, cut, each_pair, grown, longest, measured, spread
from .grids import offsets

_NORMAL = T.StructType([T.StructField(n, T.DoubleType()) for n in ("nx", "ny", "nz", "curvature")])


def cell_of(col: str, size: float) -> Column:
    return F.floor(F.col(col) / size)


#: Rows of the left side in one part of a cube.
PART = 4096


def meet(left: DataFrame, right: DataFrame, keys: list[str], cube: list[str]) -> DataFrame:
    """Pairs of rows in touching cubes; ``keys`` and the integer columns ``cube`` name a row's own cube on both sides.

    Every row of ``left`` stays in its cube and ``right`` is repeated into the cubes around that hold
    any, so all pairs of a left row are made in one task: grouping them by ``keys, cube, _p`` and the row's own
    columns shuffles no pair. The left rows of a crowded cube are dealt over parts ``_p``. Runs jobs.
    """
    held = measured(left.groupBy(*keys, *cube).agg(F.ceil(F.count("*") / PART).cast("int").alias("_m")))
    near = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, cube)]) for o in offsets(1, len(cube))]))
    asks = held.withColumn("_o", near).select(*keys, *[(F.col(c) + F.col(f"_o.{c}")).alias(c) for c in cube], *[F.col(c).alias(f"_q{c}") for c in cube], "_m")
    rhs = right.join(grown(asks), [*keys, *cube]).drop(*cube).withColumnsRenamed({f"_q{c}": c for c in cube})
    parts = held.agg(F.max("_m")).first()[0] or 1
    if parts == 1:
        lhs, rhs = left.withColumn("_p", F.lit(0)), rhs.drop("_m").withColumn("_p", F.lit(0))
    else:
        lhs = left.join(held, [*keys, *cube]).withColumn("_p", F.pmod(F.xxhash64(*left.columns), F.col("_m")).cast("int")).drop("_m")
        rhs = rhs.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_m")
    return lhs.join(grown(rhs), [*keys, *cube, "_p"])


def bucket_join(left: DataFrame, right: DataFrame, axes: list[str], size: float, by: list[str]) -> DataFrame:
    """Pairs whose cubes of edge ``size`` touch; the caller applies the exact distance.

    The right-hand axes come back as ``q<axis>``, and the left row's cube as ``_k<axis>`` and ``_p`` (``meet``); other column
    names must not clash. Runs jobs.
    """
    k = [f"_k{a}" for a in axes]
    lhs = left.withColumns({c: cell_of(a, size) for a, c in zip(axes, k)})
    rest = [c for c in right.columns if c not in axes + by]
    rhs = right.select(*by, *rest, *[F.col(a).alias(f"q{a}") for a in axes], *[cell_of(a, size).alias(c) for a, c in zip(axes, k)])
    return meet(lhs, rhs, by, k)


#: Cube columns of ``bucket_join`` in three dimensions.
CUBE = ["_kx", "_ky", "_kz", "_p"]


def distance2(axes: list[str]) -> Column:
    return sum(((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in axes[1:]),
               (F.col(axes[0]) - F.col(f"q{axes[0]}")) * (F.col(axes[0]) - F.col(f"q{axes[0]}")))


def uniform_sample(points: DataFrame, leaf: float, by: list[str], tie: str = "idx") -> DataFrame:
    """One point per cubic leaf: the one nearest the leaf centre, lowest ``tie`` first."""
    keys = [cell_of(a, leaf).alias(f"_k{a}") for a in "xyz"]
    off = [F.col(a) - (F.floor(F.col(a) / leaf) + 0.5) * leaf for a in "xyz"]
    rest = [c for c in points.columns if c not in (*by, tie)]
    best = F.min(F.struct((off[0] * off[0] + off[1] * off[1] + off[2] * off[2]).alias("d"), tie, *rest)).alias("p")
    return points.groupBy(*by, *keys).agg(best).select(*by, f"p.{tie}", *[f"p.{c}" for c in rest]).select(*points.columns)


def adaptive_leaf(n: int, leaf: float, limit: float) -> float:
    return leaf * math.sqrt(n / limit) if n > limit else leaf


def sample_to(points: DataFrame, leaf: float, limit: float, tie: str = "idx") -> DataFrame:
    """Sample, and once more with a larger leaf when more than ``limit`` points remain. Runs a job."""
    first = cut(uniform_sample(points, leaf, [], tie), "sample")
    n = first.count()
    return first if n <= limit else uniform_sample(first, adaptive_leaf(n, leaf, limit), [], tie)


def positions(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by, "x", "y", "z").agg(F.count("*").alias("n"))


def covariance_radius(queries: DataFrame, points: DataFrame, r: float, by: list[str]) -> DataFrame:
    """Centroid and covariance of the points within ``r`` of each query (itself included).

    Queries at one position are answered once. Runs jobs.
    """
    axes = ["x", "y", "z"]
    data, here = positions(points, by), [*by, *axes]
    pairs = bucket_join(queries.select(*here).distinct(), data, axes, r, by).where(distance2(axes) <= r * r)
    return grown(queries.select(*by, "idx", *axes)).join(_moments(pairs, [*by, *CUBE]).drop(*CUBE), here).select(*by, "idx", "k", *MOMENTS, *axes)


MOMENTS = ["mx", "my", "mz", "cxx", "cxy", "cxz", "cyy", "cyz", "czz"]


def _moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Weighted moments about the query position, then the covariance."""
    d = {a: F.col(f"q{a}") - F.col(a) for a in "xyz"}
    two = ["xx", "xy", "xz", "yy", "yz", "zz"]
    s = pairs.groupBy(*by, "x", "y", "z").agg(
        F.sum("n").alias("k"), *[F.sum(d[a] * F.col("n")).alias(f"s{a}") for a in "xyz"],
        *[F.sum(d[p[0]] * d[p[1]] * F.col("n")).alias(f"s{p}") for p in two])
    k = F.col("k")
    return s.select(
        *by, "k", *[(F.col(a) + F.col(f"s{a}") / k).alias(f"m{a}") for a in "xyz"],
        *[(F.col(f"s{p}") / k - F.col(f"s{p[0]}") * F.col(f"s{p[1]}") / (k * k)).alias(f"c{p}") for p in two],
        "x", "y", "z")


@F.pandas_udf(_NORMAL)
def _smallest_direction(xx, xy, xz, yy, yz, zz, x, y, z):  # noqa: ANN001
    import numpy as np
    import pandas as pd

    m = np.stack([np.stack(r, -1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -2).astype(float)
    values, vectors = np.linalg.eigh(m)
    n = vectors[:, :, 0]
    away = n[:, 0] * x.to_numpy() + n[:, 1] * y.to_numpy() + n[:, 2] * z.to_numpy() > 0
    n = np.where(away[:, None], -n, n)
    total = values.sum(1)
    curv = np.where(total > 0, np.abs(values[:, 0]) / np.where(total > 0, total, 1.0), 0.0)
    return pd.DataFrame({"nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "curvature": curv})


def normals_of(cov: DataFrame, by: list[str], at_least: int = 3) -> DataFrame:
    """Normal facing the scanner and curvature, from covariance rows."""
    c = cov.where(F.col("k") >= at_least)
    return c.withColumn("_n", _smallest_direction(*[f"c{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz")], "x", "y", "z")).select(
        *by, "idx", "x", "y", "z", "_n.nx", "_n.ny", "_n.nz", "_n.curvature")


def normals_radius(queries: DataFrame, points: DataFrame, r: float = 0.03, by: list[str] | None = None) -> DataFrame:
    by = by or ["scan_id"]
    return normals_of(covariance_radius(queries, points, r, by), by)


LEVELS, BAND = 21, 7
_GRID, _CELL = ["_gx", "_gy", "_gz"], ["_cx", "_cy", "_cz"]


class Octree:
    """Nested cubes over a set of positions; level 0 is the whole, each level halves the edge.

    A position's cube at level l is its integer place on the finest grid, shifted right, so cubes
    nest exactly and levels below 0 double the whole. Runs a job.
    """

    def __init__(self, data: DataFrame, by: list[str]):
        ends = data.agg(*[f(a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"]).first()
        self.low = [ends[f"lo{a}"] or 0.0 for a in "xyz"]
        spans = [(ends[f"hi{a}"] or 0.0) - low for a, low in zip("xyz", self.low)]
        self.edge = max(max(spans) * (1 + 1e-9), 1e-6)
        self.by = by

    def placed(self, df: DataFrame) -> DataFrame:
        """Add the place on the finest grid."""
        fine = self.edge / 2**LEVELS
        return df.withColumns({g: F.floor((F.col(a) - low) / fine).cast("long") for g, a, low in zip(_GRID, "xyz", self.low)})

    def reach(self, level: Column) -> Column:
        """Distance within which the cubes around a position's own cube hold everything."""
        return F.lit(self.edge * (1 - 1e-9)) / F.pow(F.lit(2.0), level)

    def crowded(self, placed: DataFrame, want: int) -> DataFrame:
        """by, level, cube, n of every cube below the whole that holds at least ``want`` positions.

        ``BAND`` levels are counted at a time (combined before the shuffle); only positions in a crowded
        cube of the last of them go on. Runs jobs.
        """
        rest, found = placed.select(*self.by, *_GRID), None
        for top in range(0, LEVELS, BAND):
            each = rest.withColumn("level", F.explode(F.sequence(F.lit(top + 1), F.lit(top + BAND))))
            each = each.withColumns({c: cube(g) for c, g in zip(_CELL, _GRID)})
            counts = cut(each.groupBy(*self.by, "level", *_CELL).agg(F.count("*").alias("n")).where(F.col("n") >= want), "cubes")
            found = counts if found is None else found.unionByName(counts)
            full = counts.where(F.col("level") == top + BAND).select(*self.by, *_CELL)
            if full.isEmpty():
                break
            inner = rest.withColumns({c: F.shiftright(g, LEVELS - top - BAND) for c, g in zip(_CELL, _GRID)})
            rest = cut(inner.join(full, self.by + _CELL, "left_semi").select(rest.columns), "crowd")
        return found

    def levels(self, placed: DataFrame, crowded: DataFrame) -> DataFrame:
        """Add to each position the level below the deepest at which its cube is crowded, so that its own is not (0 if none is)."""
        deepest = crowded.agg(F.max("level")).first()[0] or 0
        every = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
        every = every.withColumns({c: cube(g) for c, g in zip(_CELL, _GRID)}).join(grown(crowded), [*self.by, "level", *_CELL], "left")
        deep = F.max(F.when(F.col("n").isNotNull(), F.col("level") + 1).otherwise(0)).alias("level")
        return every.groupBy(placed.columns).agg(deep)


def cube(grid: str) -> Column:
    """Cube of a place on the finest grid at the row's ``level``."""
    return F.expr(f"shiftright({grid}, {LEVELS} - level)")


#: A cube that holds this many times k is crowded; around its eighths the edge of one reaches k in most cases.
CROWD = 2.5
SHELLS = 16


def nearest_positions(queries: DataFrame, data: DataFrame, k: int, by: list[str], max_rounds: int = 60) -> DataFrame:
    """Exact k nearest positions among the points ``data`` of every distinct position in ``queries``.

    Returns ``by, x, y, z, qx, qy, qz, n, d2, upto`` with the nearest positions until their weights
    (numbers of points) reach ``k``. A query looks into the 27 cubes around its own at its own level of the octree: the
    highest at which its cube holds fewer than ``CROWD`` times k. It is settled once k lie within the
    edge of a cube, otherwise it goes up one level. Pairs are made twice: first only counted by distance, then
    those kept that can be among the k nearest. Runs jobs.
    """
    axes = ["x", "y", "z"]
    tree = Octree(data, by)
    held = cut(tree.placed(positions(data, by)), "knn-data")
    group = held.groupBy(*by).agg(F.sum("n").alias("_all"))
    group = measured(group) if by else group
    asked = queries.select(*by, *axes).distinct()
    asked = tree.placed(asked.join(group, by, "left_semi") if by else asked)
    waiting = cut(tree.levels(asked, tree.crowded(held, math.ceil(CROWD * k))), "knn-wait")
    whole = None if by else group.first()["_all"]
    done = held.where("false").select(*by, *axes, *[F.col(a).alias(f"q{a}") for a in axes], "n", F.lit(0.0).alias("d2"), F.lit(0).cast("long").alias("upto"))
    if whole is None and not by:
        return done
    key = by + axes
    cube_of = [*by, "level", *_CELL, "_p"]
    for _ in range(max_rounds):
        used = [r["level"] for r in waiting.select("level").distinct().collect()]
        if not used:
            return done
        own = {c: cube(g) for g, c in zip(_GRID, _CELL)}
        rhs = held.withColumn("level", F.explode(F.lit(sorted(used)))).withColumns(own).select(*by, "level", *_CELL, *[F.col(a).alias(f"q{a}") for a in axes], "n")
        # Positions beyond the edge may be preceded by unseen ones.
        reach2 = tree.reach(F.col("level")) * tree.reach(F.col("level"))
        pairs = meet(waiting.withColumns(own).select(*key, "level", *_CELL), rhs, [*by, "level"], _CELL).withColumn("d2", distance2(axes))
        # How many lie within shells of equal volume tells how far to look, so that few pairs are sorted.
        shell = lambda i: reach2 * (i / SHELLS) ** (2 / 3)
        within = [F.sum(F.when(F.col("d2") <= shell(i), F.col("n"))).alias(f"_s{i}") for i in range(1, SHELLS + 1)]
        seen = pairs.where(F.col("d2") <= reach2).groupBy(*cube_of, *axes).agg(*within).withColumnRenamed(f"_s{SHELLS}", "_got")
        known = seen.join(group, by) if by else seen.withColumn("_all", F.lit(whole))
        known = known.where((F.col("_got") >= k) | (F.col("_got") >= F.col("_all")))
        far = F.coalesce(*[F.when(F.col(f"_s{i}") >= k, shell(i)) for i in range(1, SHELLS)], reach2)
        known = cut(known.select(*key, "level", *_CELL, far.alias("_far")), "knn")
        pairs = meet(known, rhs, [*by, "level"], _CELL).withColumn("d2", distance2(axes)).where(F.col("d2") <= F.col("_far"))
        w = W.partitionBy(*cube_of, *axes).orderBy("d2", "qx", "qy", "qz")
        best = pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
        best = best.withColumn("upto", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("upto") - F.col("n") < k)
        done = done.unionByName(best.select(done.columns))
        waiting = cut(waiting.join(grown(known.select(*key)), key, "left_anti").withColumn("level", F.col("level") - 1), "knn-wait")
    raise RuntimeError("nearest neighbours did not settle")


def knn(queries: DataFrame, points: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Exact k nearest positions of each query, the query's own position included.

    Returns ``by, idx, x, y, z, qx, qy, qz, n, d2, upto`` with the nearest positions until their
    weights reach ``k``. Queries at one position are answered once. Runs jobs.
    """
    near = nearest_positions(queries, points, k, by)
    return queries.select(*by, "idx", "x", "y", "z").join(near, [*by, "x", "y", "z"]).select(*by, "idx", *near.columns[len(by):])


def normals_knn(queries: DataFrame, points: DataFrame, k: int = 30, by: list[str] | None = None) -> DataFrame:
    by = by or ["scan_id"]
    here = [*by, "x", "y", "z"]
    near = nearest_positions(queries, points, k, by).withColumn(
        "n", F.least(F.col("n"), F.lit(k) - (F.col("upto") - F.col("n"))))
    return normals_of(grown(queries.select("idx", *here)).join(_moments(near, by), here), by)


def mean_distance(points: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Mean distance of every point to its k nearest others."""
    here = [*by, "x", "y", "z"]
    near = nearest_positions(points, points, k + 1, by).withColumn(
        "n", F.least(F.col("n"), F.lit(k + 1) - (F.col("upto") - F.col("n"))))
    s = near.groupBy(*here).agg(F.sum(F.sqrt("d2") * F.col("n")).alias("_s"), F.sum("n").alias("_k"))
    return grown(points).join(s.where(F.col("_k") > 1), here).select(*by, "idx", (F.col("_s") / (F.col("_k") - 1)).alias("mean_dist"))


def drop_statistical_outliers(points: DataFrame, k: int = 50, m: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """Drop points whose mean neighbour distance exceeds mean + m sigma of their cloud."""
    by = by or []
    d = cut(mean_distance(points, k, by), "outliers")
    lim = (F.avg("mean_dist") + F.stddev_samp("mean_dist") * m).alias("_lim")
    if by:
        d = d.join(measured(d.groupBy(*by).agg(lim)), by).where(F.col("mean_dist") <= F.col("_lim"))
    else:
        d = d.where(F.col("mean_dist") <= d.agg(lim).scalar())
    return points.join(grown(d.select(*by, "idx")), by + ["idx"], "left_semi")


def nearest(source: DataFrame, target: DataFrame, limit: float, by: list[str],
            features: list[str] | None = None, weights: list[float] | None = None) -> DataFrame:
    """Nearest target of every source row within ``limit`` (rows without one drop out).

    ``features`` extends the distance with further columns present on both sides;
    ``weights`` rescales them. Returns the source row with ``qx, qy, qz`` and ``d2``.
    """
    axes = ["x", "y", "z"]
    features = features or []
    weights = weights or [1.0] * len(features)
    rhs = target.select(*by, *axes, *[F.col(f).alias(f"q{f}") for f in features]).distinct()
    d2 = distance2(axes)
    for f, wgt in zip(features, weights):
        d2 = d2 + (F.col(f) - F.col(f"q{f}")) * (F.col(f) - F.col(f"q{f}")) * (wgt * wgt)
    rest = [c for c in source.columns if c not in (*by, "idx")]
    slim = source.select(*by, "idx", *axes, *features)

    def closest(rows: DataFrame, size: float) -> DataFrame:
        pairs = bucket_join(rows, rhs, axes, size, by).withColumn("d2", d2).where(F.col("d2") <= size * size)
        near = pairs.groupBy(*by, *CUBE, "idx").agg(F.min("d2").alias("_d2"))
        return near.groupBy(*by, "idx").agg(F.min("_d2").alias("_d2")).withColumn("_size", F.lit(size))

    # Where targets are dense, small cubes answer nearly all rows; the distance is only a number until it is known.
    size = limit / 2 ** dense_levels(rhs, axes, limit, by)
    best = closest(slim, size)
    if size < limit:
        best = cut(best, "nearest")
        best = cut(best.unionByName(closest(slim.join(grown(best.select(*by, "idx")), [*by, "idx"], "left_anti"), limit)), "nearest")
    found = None
    asked = source.join(grown(best), [*by, "idx"])
    for step in sorted({size, limit}):
        pairs = bucket_join(asked.where(F.col("_size") == step).drop("_size"), rhs, axes, step, by).withColumn("d2", d2).where(F.col("d2") <= F.col("_d2"))
        part = pairs.groupBy(*by, "idx").agg(F.min(F.struct("d2", "qx", "qy", "qz", *rest)).alias("p")).select(*by, "idx", "p.*")
        found = part if found is None else found.unionByName(part)
    return found


def dense_levels(points: DataFrame, axes: list[str], size: float, by: list[str], want: float = 4.0) -> int:
    """How often cubes of edge ``size`` can be halved until the cube around an average point holds about ``want``. Runs a job."""
    load = points.groupBy(*by, *[cell_of(a, size) for a in axes]).agg(F.count("*").cast("double").alias("n"))
    mean = load.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    return max(0, int(math.log(mean / want, 2 ** len(axes)))) if mean > want else 0


#: ``refine`` searches this many times its limit, so that rows without a target need not be searched again after a short way.
SLACK = 1.125
#: It starts with cubes that hold about so many targets, and allows for this much rounding in a distance (metres).
LOAD, CLOSE = 0.25, 1e-9


def with_nearest(rows: DataFrame, targets: DataFrame, limit: float, levels: int, by: list[str],
                 features: list[str], weights: list[float]) -> DataFrame:
    """Every row with its nearest target ``qx, qy, qz``, the features' share ``_f2`` of their squared distance, and ``low``.

    No other target is nearer than ``low``. Rows without a target within ``limit`` keep nulls and have ``low`` = ``limit``.
    Radii double from ``limit / 2**levels`` on, and only rows that found nothing go on, so a row is
    paired with few targets. ``targets`` is distinct, with features as ``q<feature>``. Runs jobs.
    """
    axes, columns = ["x", "y", "z"], rows.columns
    f2 = F.lit(0.0)
    for f, wgt in zip(features, weights):
        f2 = f2 + (F.col(f) - F.col(f"q{f}")) * (F.col(f) - F.col(f"q{f}")) * (wgt * wgt)
    here = W.partitionBy(*by, *CUBE, "idx").orderBy("_d2", "qx", "qy", "qz")
    found = None
    for level in range(levels, -1, -1):
        edge = limit / 2**level
        pairs = bucket_join(rows, targets, axes, edge, by).withColumn("_f2", f2).withColumn("_d2", distance2(axes) + F.col("_f2"))
        best = pairs.where(F.col("_d2") <= edge * edge).withColumn("_rn", F.row_number().over(here)).withColumn("_next", F.lead("_d2").over(here))
        best = cut(best.where("_rn = 1").select(*columns, "qx", "qy", "qz", "_f2", F.least(F.sqrt("_next"), F.lit(edge)).alias("low")), "nearest")
        found = best if found is None else found.unionByName(best)
        rows = cut(rows.join(grown(best.select(*by, "idx")), [*by, "idx"], "left_anti"), "waiting")
        if rows.isEmpty():
            return found
    return found.unionByName(rows.select(*columns, *[F.lit(None).cast("double").alias(c) for c in ("qx", "qy", "qz", "_f2")], F.lit(limit).alias("low")))


def fit_rigid(matches: DataFrame, by: list[str]) -> DataFrame:
    """Least-squares rigid transform of matched pairs: ``by, n, fitness, m``."""
    s = matches.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("d2").alias("fitness"),
        *[F.avg(a).alias(f"_{a}") for a in "xyz"], *[F.avg(f"q{a}").alias(f"_q{a}") for a in "xyz"],
        *[F.covar_pop(a, f"q{b}").alias(f"s{a}{b}") for a in "xyz" for b in "xyz"])
    r = G.with_rotation(s.where("n >= 3"))
    row = lambda i: [F.col(f"r{3 * i + j}") for j in range(3)]
    shift = lambda i: F.col(f"_q{'xyz'[i]}") - sum((row(i)[j] * F.col(f"_{a}") for j, a in enumerate("xyz")), F.lit(0.0))
    cells = [c for i in range(3) for c in (*row(i), shift(i))]
    return r.select(*by, "n", "fitness", F.array(*cells, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]).alias("m"))


def refine(source: DataFrame, target: DataFrame, by: list[str], rounds: int = 30, inner: int = 2,
           limit: float = 0.1, shrink: float = 0.001, eps: float = 1e-6, max_fitness: float = 20.0,
           features: list[str] | None = None, weights: list[float] | None = None) -> DataFrame:
    """Iterated closest-point alignment of every group at once.

    Each round matches source rows to their nearest targets within the limit and
    applies the least-squares motion ``inner`` times. Matches are kept between rounds, and a row is searched
    again only when it has moved so far that another target may be nearest. A group is given up when its
    accumulated motion is not small or its fitness exceeds ``max_fitness``, and is
    finished when the motion has settled over four rounds; its own limit shrinks in every
    round in which it does not move. Runs jobs.
    Returns ``by, m, ok, settled``; ``settled`` is false where the rounds ran out first.
    """
    eye = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    state = cut(source.select(*by).distinct().select(
        *by, eye.alias("m"), F.lit(True).alias("ok"), F.array().cast("array<array<double>>").alias("past"),
        F.lit(False).alias("settled"), F.lit(limit).alias("limit")), "refine")
    axes, features = ["x", "y", "z"], features or []
    weights = weights or [1.0] * len(features)
    rhs = cut(target.select(*by, *axes, *[F.col(f).alias(f"q{f}") for f in features]).distinct(), "targets")
    reach = limit * SLACK
    levels = dense_levels(rhs, axes, reach, by, LOAD)
    rows = [*by, "idx", "_x", "_y", "_z", *features]
    held = source.select(*by, "idx", *[F.col(a).alias(f"_{a}") for a in axes], *features)
    searched = False

    def placed(step: DataFrame) -> DataFrame:
        """Held rows of the groups in ``step`` with their present place ``_tx, _ty, _tz``."""
        # Single cells and no divide (the last row of a motion is 0, 0, 0, 1) keep the code of the scan short enough to be compiled.
        cells = step.select(*by, F.col("limit").alias("_limit"), *[F.col("m")[i].alias(f"_m{i}") for i in range(12)])
        t = [F.col(f"_m{4 * i}") * F.col("_x") + F.col(f"_m{4 * i + 1}") * F.col("_y") + F.col(f"_m{4 * i + 2}") * F.col("_z") + F.col(f"_m{4 * i + 3}") for i in range(3)]
        return held.join(cells, by).select(*held.columns, "_limit", *[c.alias(f"_t{a}") for c, a in zip(t, axes)])

    def searched_from(now: DataFrame) -> DataFrame:
        return with_nearest(now.select(*rows, *[F.col(f"_t{a}").alias(a) for a in axes]), rhs, reach, levels, by, features, weights)

    def length2(of: str) -> Column:
        d = [F.col(f"_t{a}") - F.col(f"{of}{a}") for a in axes]
        return d[1] * d[1] + d[2] * d[2] + d[0] * d[0]

    # No other target is nearer than ``low`` to where a row was searched from, so none is nearer than ``low`` less the way since.
    sure = F.col("low") - F.sqrt(length2("")) - CLOSE > F.least(F.sqrt("_d2"), F.col("_limit"))
    for _ in range(rounds):
        if state.where("ok AND NOT settled").isEmpty():
            break
        step = state.where("ok AND NOT settled").select(*by, "m", "limit")
        for _ in range(inner):
            if not searched:
                held, searched = searched_from(placed(step)), True
            now = placed(step).withColumn("_d2", length2("q") + F.col("_f2"))
            if not now.where(~sure).isEmpty():
                held = cut(now.where(sure).select(*held.columns).unionByName(searched_from(now.where(~sure))), "matches")
                now = placed(step).withColumn("_d2", length2("q") + F.col("_f2"))
            found = now.where(F.col("_d2") <= F.col("_limit") * F.col("_limit"))
            fit = fit_rigid(found.select(*by, *[F.col(f"_t{a}").alias(a) for a in axes], "qx", "qy", "qz", F.col("_d2").alias("d2")), by).select(
                *by, F.col("m").alias("_d"), "fitness")
            step = cut(step.select(*by, "m", "limit").join(fit, by, "left").select(
                *by, "limit", F.coalesce(G.multiply(F.col("_d"), F.col("m"), 4), F.col("m")).alias("m"), "fitness"), "refine")
        new = step.select(*by, F.col("m").alias("_m"), F.col("fitness").alias("_f"))
        gap = lambda p, q: F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
        good = G.is_small_motion(F.col("_m")) & (F.coalesce(F.col("_f"), F.lit(1e9)) <= max_fitness)
        spread4 = F.aggregate(F.transform("past", lambda p: gap(p, F.col("_m"))), F.lit(0.0), lambda s, v: s + v) / 4.0
        joined = state.join(new, by, "left")
        active = F.col("_m").isNotNull()
        still = active & (gap(F.col("_m"), F.col("m")) < eps)
        state = cut(joined.select(
            *by, F.when(active & good, F.col("_m")).otherwise(F.col("m")).alias("m"),
            F.when(active, good).otherwise(F.col("ok")).alias("ok"),
            F.when(active, F.slice(F.concat(F.array("_m"), F.col("past")), 1, 4)).otherwise(F.col("past")).alias("past"),
            F.when(active, (F.size("past") == 4) & (spread4 < eps)).otherwise(F.col("settled")).alias("settled"),
            F.when(still, F.greatest(F.col("limit") - shrink, F.lit(shrink))).otherwise(F.col("limit")).alias("limit")), "refine")
    return state.select(*by, F.when(F.col("ok"), F.col("m")).otherwise(eye).alias("m"), "ok", (F.col("ok") & F.col("settled")).alias("settled"))


def points_in_box(points: DataFrame, box: DataFrame, by: list[str], tile: float = 2.0) -> DataFrame:
    """Points inside each group's box, tagged with the group.

    Boxes are laid out as floor tiles and meet the points by an equi-join on the tile.
    """
    lim = box.select(*by, *[f"{a}{i}" for a in "xyz" for i in "01"])
    span = lambda a: F.sequence(F.floor(F.col(f"{a}0") / tile), F.floor(F.col(f"{a}1") / tile))
    tiles = lim.withColumn("_tx", F.explode(span("x"))).withColumn("_ty", F.explode(span("y")))
    data = points.select("*", cell_of("x", tile).alias("_tx"), cell_of("y", tile).alias("_ty"))
    hit = data.join(tiles, ["_tx", "_ty"])
    for a in "xyz":
        hit = hit.where(F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1")))
    return hit.select(*by, *[c for c in points.columns if c not in by])


def near_pairs(nodes: DataFrame, scale: float, d: float = 1.5, block: int = 8192) -> DataFrame:
    """Ordered pairs of nodes closer than ``d`` metres on the plan.

    Nodes at one position are compared as a bunch. Every bunch meets the bunches of its cell and the cells around
    it; a cell with many nodes is split into blocks of about ``block`` nodes a side. Runs jobs.
    """
    px, cell = d * scale, ["_kx", "_ky"]
    here = nodes.select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"])
    at = cut(bunched(here, ["x", "y"], "node_id", min(BUNCH, block)), "placed").withColumn("_own", F.struct("x", "y", "_bunch"))
    rhs = at.select(F.col("_own").alias("_b"), F.col("_ids").alias("_bs"), F.col("x").alias("qx"), F.col("y").alias("qy"), cell_of("x", px).alias("_kx"), cell_of("y", px).alias("_ky"))
    near = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(o, cell)]) for o in offsets(1, 2)]))
    lhs = at.withColumn("_o", near).select(F.col("_own").alias("_a"), F.col("_ids").alias("_as"), "x", "y", (cell_of("x", px) + F.col("_o._kx")).alias("_kx"), (cell_of("y", px) + F.col("_o._ky")).alias("_ky"))
    lhs, rhs = blocks(lhs, rhs, cell, "_a", "_b", block, (F.size("_as"), F.size("_bs")))
    on = [*cell, "_p", "_q"]
    pairs = spread(lhs.drop("_a"), *on).join(grown(spread(rhs.drop("_b"), *on)), on)
    pairs = pairs.where(F.sqrt(distance2(["x", "y"])) / scale < d).select("_as", "_bs")
    return each_pair(pairs, "_as", "_bs", "a", "b", longest(at)).where(F.col("a") != F.col("b"))
