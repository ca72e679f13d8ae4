"""Means, deviations, consensus values and dominant directions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..stages import cut, measured

INLIER_ANGLE = 0.02


def mean_stdev(df: DataFrame, by: list[str], value: Column, where: Column | None = None,
               mean: str = "mean", sigma: str = "sigma") -> DataFrame:
    """Mean and n-1 deviation of ``value`` over the rows that satisfy ``where``."""
    v = value if where is None else F.when(where, value)
    return df.groupBy(*by).agg(F.avg(v).alias(mean), F.stddev_samp(v).alias(sigma))


def box_stats(points: DataFrame, by: list[str]) -> DataFrame:
    """Per-axis mean and deviation: ``mean_x, sigma_x, ...``."""
    aggs = []
    for a in "xyz":
        aggs += [F.avg(a).alias(f"mean_{a}"), F.stddev_samp(a).alias(f"sigma_{a}")]
    return points.groupBy(*by).agg(*aggs)


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per distinct value with its multiplicity."""
    return df.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))


def dominant_of_counts(counts: DataFrame, by: list[str], tol: float = 0.03) -> DataFrame:
    """Value whose open neighbourhood of half-width ``tol`` holds most rows.

    Returns ``by, centre, support, dominant`` where ``dominant`` is the mean of the
    neighbourhood; the smallest value wins a tie. Works on value counts, cut into
    strips of width ``tol``: a neighbourhood reaches only the adjacent strips, so
    each strip is sorted on its own and groups of any size stay distributed.
    """
    # Each value is a row that counts, and two probes that ask how much lies before them.
    probe = lambda kind, at, n: F.struct(F.lit(kind).alias("kind"), at.alias("at"), n.cast("long").alias("n"))
    v = F.col("v")
    rows = counts.select(*by, v.alias("own"), F.explode(F.array(
        probe(0, v, F.col("n")), probe(1, v + tol, F.lit(0)), probe(-1, v - tol, F.lit(0)))).alias("e"))
    rows = rows.select(*by, "own", "e.*", F.floor(F.col("e.at") / tol).alias("b"))
    # Mass below an upper probe excludes ties; below a lower probe it includes them.
    inside = W.partitionBy(*by, "b").orderBy("at", F.when(F.col("kind") == 0, 0).otherwise(-F.col("kind")))
    run = inside.rowsBetween(W.unboundedPreceding, 0)
    mass = F.col("n") * F.col("at")
    ranked = rows.withColumn("below", F.sum("n").over(run)).withColumn("sum_below", F.sum(mass).over(run)).where("kind <> 0")
    # One row per strip and group, so the running total over strips stays small.
    strips = rows.groupBy(*by, "b").agg(F.sum("n").alias("sn"), F.sum(mass).alias("sv"))
    before = W.partitionBy(*by).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    strips = strips.select(*by, "b", F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("pn"),
                           F.coalesce(F.sum("sv").over(before), zero).alias("ps"))
    side = F.col("kind")
    spans = ranked.join(strips, by + ["b"]).groupBy(*by, "own").agg(
        F.sum((F.col("below") + F.col("pn")) * side).alias("support"),
        F.sum((F.col("sum_below") + F.col("ps")) * side).alias("total"))
    return spans.groupBy(*by).agg(
        F.max(F.struct("support", (-F.col("own")).alias("k"), "total")).alias("best")
    ).select(*by, (-F.col("best.k")).alias("centre"), F.col("best.support").alias("support"),
             (F.col("best.total") / F.col("best.support")).alias("dominant"))


def dominant_value(df: DataFrame, by: list[str], value: str, tol: float = 0.03) -> DataFrame:
    return dominant_of_counts(value_counts(df, by, value), by, tol)


def peel_values(df: DataFrame, by: list[str], value: str, remove: float = 0.05, until: float = -1.5,
                tol: float = 0.03) -> DataFrame:
    """Repeatedly take the dominant value and delete its surroundings.

    A group stops once two values are found and the smallest is below ``until``, or
    its values are used up. All groups advance together, one job per round.
    Returns ``by, round, dominant``.
    """
    left = cut(value_counts(df, by, value), "peel")
    found = None
    done_when = (F.col("_low") < until) & (F.col("_k") >= 2)
    k = 0
    while True:
        k += 1
        best = cut(dominant_of_counts(left, by, tol).select(
            *by, F.lit(k).alias("round"), "dominant"), "peel")
        if best.isEmpty():
            break
        found = best if found is None else found.unionByName(best)
        running = found.groupBy(*by).agg(F.min("dominant").alias("_low"), F.max("round").alias("_k"))
        open_groups = running.where(~done_when & (F.col("_k") == k)).select(*by)
        centre = best.join(open_groups, by, "left_semi").select(*by, "dominant")
        left = cut(left.join(centre, by).where(F.abs(F.col("v") - F.col("dominant")) >= remove)
                   .select(*by, "v", "n"), "peel")
    return best if found is None else found


def floor_and_span(planes: DataFrame, by: list[str]) -> DataFrame:
    """Lowest plane and height between planes. Unused slots count as zero."""
    low = F.least(F.min("dominant"), F.lit(0.0))
    high = F.greatest(F.max("dominant"), F.lit(0.0))
    return planes.groupBy(*by).agg(low.alias("floor_coord"), (high - low).alias("dz"))


CONFIDENCE, LEAST_SHARE = 0.999, 0.001


def trials_needed(support: Column, total: Column) -> Column:
    """Hypotheses after which the best one is good enough with the wanted confidence."""
    share = F.greatest(F.lit(LEAST_SHARE), F.pow((support - 3.0) / total, F.lit(3.0)))
    return F.log(F.lit(1.0 - CONFIDENCE)) / F.log(1.0 - share)


def in_seeded_order(items: DataFrame, key: str, seed: int) -> DataFrame:
    """Add a hash fixed by the seed, whose order is a random one, and its place between 0 and 1."""
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return items.withColumn("_h", h).withColumn("_place", F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") / float(16**13))


def until_settled(hypotheses: DataFrame, key: str, total: DataFrame, by: list[str],
                  score: Callable[[DataFrame], DataFrame], seed: int, first: int = 512) -> DataFrame:
    """Try hypotheses in a seeded order until the best of each group is good enough.

    ``total`` has ``by, total`` (items per group); ``score`` returns ``by, k, support, found``
    for a batch of hypotheses, whose places in the order are ``k``. A hypothesis counts if those
    before it did not yet suffice; the earliest with the greatest support wins.

    A batch is what has its hash below a threshold and not below the last one: about ``first`` rows
    of every group that is not settled, twice as many in each further round. Only the batch is
    ranked, and a group needs fewer than 7000 hypotheses whatever its size (``trials_needed``).
    A group whose hypotheses are used up ends with what it has. Runs jobs.
    """
    hashed = in_seeded_order(hypotheses, key, seed)
    sizes = hypotheses.groupBy(*by).agg(F.count("*").alias("_n"))
    state = cut(total.join(sizes, by).select(*by, "total", "_n", F.lit(None).cast("long").alias("best"), F.lit(0).cast("long").alias("_drawn")), "trials")
    found, low = None, 0
    before = W.partitionBy(*by).orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    order = W.partitionBy(*by).orderBy("_h", key)
    while True:
        more = F.col("best").isNull() | (F.col("_drawn") < trials_needed(F.col("best"), F.col("total")))
        left = state.where(more & (F.lit(low) < F.col("_n"))).select(*by, "_n", "_drawn")
        if left.isEmpty():
            break
        high = low + first
        below = lambda n: F.col("_place") < F.lit(float(n)) / F.col("_n")
        batch = hashed.join(left, by).where(below(high) & ~below(low)).withColumn("k", F.col("_drawn") + F.row_number().over(order))
        batch = measured(batch.drop("_h", "_place", "_n", "_drawn"))
        tried = score(batch).join(state, by).withColumn("_before", F.greatest("best", F.max("support").over(before)))
        counts = F.col("_before").isNull() | (F.col("k") - 1 < trials_needed(F.col("_before"), F.col("total")))
        new = cut(tried.where(counts).groupBy(*by).agg(
            F.max(F.struct("support", (-F.col("k")).alias("_k"), "found")).alias("b")), "trials")
        found = new if found is None else found.unionByName(new)
        better = F.col("best").isNull() | (F.col("b.support") > F.col("best"))
        got = batch.groupBy(*by).agg(F.count("*").alias("_got"))
        state = cut(state.join(new, by, "left").join(got, by, "left").select(
            *by, "total", "_n", F.when(better & F.col("b").isNotNull(), F.col("b.support")).otherwise(F.col("best")).alias("best"),
            (F.col("_drawn") + F.coalesce("_got", F.lit(0))).alias("_drawn")), "trials")
        low, first = high, first * 2
    if found is None:
        return score(hypotheses.withColumn("k", F.lit(0).cast("long"))).where("false").select(*by, "k", "support", "found")
    top = found.groupBy(*by).agg(F.max("b").alias("b"))
    return top.select(*by, (-F.col("b._k")).alias("k"), "b.support", "b.found")


def _supported(inliers: DataFrame, v: G.Vec) -> DataFrame:
    """Support of every hypothesis, and the sign-aligned sum of its inliers."""
    sign = F.when(G.dot(v, G.vec("h")) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    per = inliers.groupBy("scan_id", "k", "h").agg(
        F.count("*").alias("support"), *[F.sum(c * sign).alias(f"s{n}") for c, n in zip(v, "xyz")])
    return per.select("scan_id", "k", "support", F.struct("h", "sx", "sy", "sz").alias("found"))


def _direction(normals: DataFrame, seed: int, inliers: Callable[[DataFrame], DataFrame], v: G.Vec,
               normalise: bool) -> DataFrame:
    names = {"idx": "h", "nx": "hx", "ny": "hy", "nz": "hz"}
    tried = normals.select("scan_id", *names).withColumnsRenamed(names)
    total = normals.groupBy("scan_id").agg(F.count("*").alias("total"))
    best = until_settled(tried, "h", total, ["scan_id"], lambda batch: _supported(inliers(batch), v), seed)
    s = tuple(F.col(f"found.s{n}") for n in "xyz")
    size = G.norm(s) if normalise else F.col("support")
    return best.select("scan_id", "found.h", "support", *[(c / size).alias(f"m{n}") for c, n in zip(s, "xyz")])


def dominant_direction(normals: DataFrame, seed: int = 7) -> DataFrame:
    """Direction shared by most normals of a scan, found by seeded consensus.

    Normals stand as hypotheses in a seeded order until the best one suffices. Every
    normal meets a batch of hypotheses of its scan and the counts are combined before
    the shuffle, so a dominant scan only adds map tasks. Runs jobs.
    Returns ``scan_id, h, support, mx, my, mz`` (a mean, not a unit vector).
    """
    n, h = G.vec("n"), G.vec("h")
    # The cosine decides nearly all pairs before any angle is computed.
    near = (F.abs(G.dot(n, h)) > math.cos(INLIER_ANGLE) - 1e-9) & (F.acos(G.unit_clamp(F.abs(G.dot(n, h)))) < INLIER_ANGLE)
    return _direction(normals, seed, lambda batch: normals.join(batch, "scan_id").where(near), n, normalise=False)


def dominant_pair(normals: DataFrame, axis: DataFrame, seed: int = 7) -> DataFrame:
    """Two perpendicular directions at once, among normals perpendicular to ``axis``.

    ``axis`` has ``scan_id, mx, my, mz``. A normal supports a hypothesis when it
    follows either the hypothesis or its cross product with the axis. Runs jobs.
    Returns the second direction and, as ``px, py, pz``, the third.
    """
    n, h = G.vec("n"), G.vec("h")
    first = measured(axis.select("scan_id", *[F.col(f"m{c}").alias(f"a{c}") for c in "xyz"]))
    a = G.vec("a")
    sine = G.norm(G.cross(n, a))
    side = normals.join(first, "scan_id").where(F.asin(G.unit_clamp(sine)) > F.pi() / 2.0 - INLIER_ANGLE)
    off = lambda u, v: F.acos(G.unit_clamp(F.abs(G.dot(u, v))))
    turned = G.cross(n, a)
    v = tuple(F.when(F.col("d1") < INLIER_ANGLE, c).otherwise(t) for c, t in zip(n, turned))

    def inliers(batch: DataFrame) -> DataFrame:
        pairs = side.join(batch, "scan_id").withColumn("d1", off(n, h)).withColumn("d2", off(n, G.cross(h, a)))
        return pairs.where(F.least("d1", "d2") < INLIER_ANGLE)

    out = _direction(side, seed, inliers, v, normalise=True)
    third = G.cross(G.vec("m"), a)
    return out.join(first, "scan_id").select(*out.columns, *[c.alias(f"p{k}") for c, k in zip(third, "xyz")])


def consensus(items: DataFrame, candidates: DataFrame, by: list[str], inlier: Column, reducer: Column,
              seed: int = 7) -> DataFrame:
    """Generic consensus: the candidate with most inliers, and ``reducer`` over them.

    ``candidates`` has ``cand`` and is tried in a seeded order until the best suffices;
    ``inlier`` compares an item with a candidate and ``reducer`` is an aggregate. Runs jobs.
    """
    total = items.groupBy(*by).agg(F.count("*").alias("total"))

    def score(batch: DataFrame) -> DataFrame:
        per = items.join(batch, by).where(inlier).groupBy(*by, "k", "cand")
        return per.agg(F.count("*").alias("support"), reducer.alias("estimate")).select(
            *by, "k", "support", F.struct("cand", "estimate").alias("found"))

    return until_settled(candidates, "cand", total, by, score, seed).select(*by, "found.cand", "support", "found.estimate")
