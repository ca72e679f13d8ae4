"""Scoring candidate placements of scans on a floor plan.

A template is the table ``(scan_id, rot, row, col, s, e)`` of the cells under a scan's
mask: scan confidence and eroded scan confidence (0 where empty). A sheet is the plan
as ``(row, col, p, pe, inside)``: plan confidence, eroded plan confidence and whether
the cell lies inside the plan. Both may carry further key columns such as ``level``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions.weights import placement_score
from ..stages import cut, grown, measured, spread

# Fixed values of the candidate search.
SEARCH_REACH = 2                                        # inner square: 5 x 5
RING_LOW, RING_HIGH = -3, 4                             # ring around it: 28 cells, 14 pairs
CUTOFF_STEP, CUTOFF_STEPS, MINIMA_WANTED = 0.01, 100, 100

SALTS = 16
KEY = ["scan_id", "rot"]


def template(scan: DataFrame, scan_eroded: DataFrame, mask: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or KEY
    parts = [mask.select(*by, "row", "col", F.lit(True).alias("m"), F.lit(0.0).alias("s"), F.lit(0.0).alias("e")),
             scan.select(*by, "row", "col", F.lit(False).alias("m"), F.col("value").alias("s"), F.lit(0.0).alias("e")),
             scan_eroded.select(*by, "row", "col", F.lit(False).alias("m"), F.lit(0.0).alias("s"), F.col("value").alias("e"))]
    allp = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return allp.groupBy(*by, "row", "col").agg(
        F.max("m").alias("m"), F.max("s").alias("s"), F.max("e").alias("e")).where("m").drop("m")


def sheet(plan: DataFrame, plan_eroded: DataFrame, inside: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    zero = F.lit(0.0)
    parts = [plan.select(*by, "row", "col", F.col("value").alias("p"), zero.alias("pe"), F.lit(0).alias("inside")),
             plan_eroded.select(*by, "row", "col", zero.alias("p"), F.col("value").alias("pe"), F.lit(0).alias("inside")),
             inside.select(*by, "row", "col", zero.alias("p"), zero.alias("pe"), F.lit(1).alias("inside"))]
    allp = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return allp.groupBy(*by, "row", "col").agg(*[F.max(c).alias(c) for c in ("p", "pe", "inside")])


def mass_under_mask(tmpl: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mask size and scan mass under the mask."""
    return tmpl.groupBy(*(by or KEY)).agg(F.count("*").alias("n_mask"), F.sum("s").alias("scan_mass"))


def initial_candidates(sizes: DataFrame, plan_rows, plan_cols) -> DataFrame:
    """Every position where the template fits. ``sizes`` has ``rows, cols`` per template."""
    fit = sizes.where((F.col("cols") < plan_cols) & (F.col("rows") < plan_rows))
    xs = F.sequence(F.lit(0), F.lit(plan_cols) - F.col("cols") - 1)
    ys = F.sequence(F.lit(0), F.lit(plan_rows) - F.col("rows") - 1)
    return fit.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys)).select(*KEY, "x", "y")


def correlate(cands: DataFrame, tmpl: DataFrame, plan: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Overlap sums of every candidate with the plan, unmatched cells included implicitly.

    One equi-join of the shifted template cells with the sheet gives mask cells inside
    the plan, plan mass under the mask and both one-sided differences; a scan cell
    without a plan cell keeps its whole mass, so it needs no row. Templates are
    repeated over a few salts, which spreads a scan that holds most candidates.
    """
    by = by or KEY
    salt = F.pmod(F.xxhash64("x", "y"), F.lit(SALTS)).cast("int")
    t = tmpl.select(*by, "row", "col", "s", "e").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    c = spread(cands.select(*by, "x", "y").withColumn("_salt", salt), *by, "_salt")
    shifted = grown(c).join(t, by + ["_salt"]).select(
        *by, "x", "y", (F.col("row") + F.col("y")).alias("row"), (F.col("col") + F.col("x")).alias("col"), "s", "e")
    hit = shifted.join(plan, ["row", "col"])
    sums = hit.groupBy(*by, "x", "y").agg(
        F.sum("inside").alias("n_inside"), F.sum("p").alias("plan_mass"),
        F.sum(F.least("s", "pe")).alias("_shared"), F.sum(F.greatest(F.col("p") - F.col("e"), F.lit(0.0))).alias("fp_scan"))
    return sums.join(mass_under_mask(tmpl, by), by).select(
        *by, "x", "y", "n_inside", "n_mask", "plan_mass", "scan_mass",
        (F.col("scan_mass") - F.col("_shared")).alias("scan_fp"), "fp_scan")


def scale_doors(doors: DataFrame, zero_zero: DataFrame, scale: float) -> DataFrame:
    """Door corners and widths in plan pixels of level 0."""
    d = doors.join(zero_zero, KEY)
    return d.select(
        *KEY, "door_id", (F.col("corner.x") * scale + F.col("zx")).alias("cx"),
        (F.col("corner.y") * scale + F.col("zy")).alias("cy"),
        F.col("x_axis.x").alias("ax"), F.col("x_axis.y").alias("ay"), (F.col("w") * scale).alias("w"))


def doors_at_level(doors: DataFrame, level: int) -> DataFrame:
    k = float(2**level)
    return doors.select(*KEY, "door_id", *[(F.col(c) / k).alias(c) for c in ("cx", "cy")], "ax", "ay", (F.col("w") / k).alias("w"))


def door_pixels(doors: DataFrame) -> DataFrame:
    """Points along each door's span, before the candidate offset and rounding."""
    last = F.ceil("w").cast("int") - 1
    d = doors.where(last >= 0).withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    return d.select(*KEY, "door_id", "k", (F.col("cx") + F.col("k") * F.col("ax")).alias("px"),
                    (F.col("cy") + F.col("k") * F.col("ay")).alias("py"))


def nearby_response(response: DataFrame, reach: int = 2) -> DataFrame:
    """Value each plan pixel finds first in its window, scanning columns then rows."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    e = response.where("value <> 0").withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
    return e.groupBy((F.col("row") - F.col("j")).alias("row"), (F.col("col") - F.col("i")).alias("col")).agg(
        F.min_by("value", F.struct("i", "j")).alias("hit"))


def door_agreement(cands: DataFrame, doors: DataFrame, response: DataFrame) -> DataFrame:
    """Door span pixels a candidate leaves unexplained, and how many there are.

    Candidates of scans without doors get 0 of 1. Runs jobs.
    """
    # Offsets are whole, so points that round to one pixel do so under every candidate and become one row with a
    # weight. A point within rounding error of a half keeps its place: its side depends on the sign of the sum.
    half = lambda c: F.abs(F.col(c) - F.floor(c) - 0.5) < 1e-6
    whole = lambda c: F.when(half(c), F.col(c)).otherwise(F.floor(F.col(c) + 0.5).cast("double")).alias(c)
    spots = measured(door_pixels(doors).select(*KEY, whole("px"), whole("py")).groupBy(*KEY, "px", "py").agg(F.count("*").alias("n")))
    px = grown(spots).join(cands.select(*KEY, "x", "y"), KEY)
    away = lambda c: (F.signum(c) * F.floor(F.abs(c) + 0.5)).cast("int")
    px = px.select(*KEY, "x", "y", away(F.col("py") + F.col("y")).alias("row"), away(F.col("px") + F.col("x")).alias("col"), "n")
    got = px.join(measured(nearby_response(response)), ["row", "col"]).groupBy(*KEY, "x", "y").agg(
        (F.sum(F.col("hit") * F.col("n")) / 2.0).alias("_got"))
    total = doors.groupBy(*KEY).agg(F.sum(F.ceil("w")).cast("double").alias("_total"))
    zero = F.lit(0.0)
    return cands.join(total, KEY, "left").join(got, KEY + ["x", "y"], "left").select(
        *[cands[c] for c in cands.columns],
        (F.coalesce("_total", zero) - F.coalesce("_got", zero)).alias("door_uxp"),
        F.greatest(F.lit(1.0), F.coalesce("_total", zero)).alias("door_count"))


def score_candidates(sums: DataFrame) -> DataFrame:
    """Final score from gated sums with door columns; undefined scores drop out."""
    s = placement_score(*[F.col(c) for c in ("scan_fp", "scan_mass", "fp_scan", "plan_mass", "door_uxp", "door_count")])
    return sums.withColumn("score", s).where(F.col("score").isNotNull())


def local_minima(df: DataFrame, by: list[str], half: Column) -> DataFrame:
    """Rows with no strictly smaller score within ``half`` cells in x and y.

    Positions fall into blocks of edge half + 1. Two positions of a block are always
    within reach of each other, so only a block's minimum can survive; these few are
    then compared with the positions of the nine blocks around them. Runs a job.
    """
    cells = df.groupBy(*by, "x", "y").agg(F.min("score").alias("s"), F.first(half.cast("int")).alias("h"))
    edge = F.col("h") + 1
    cells = cut(cells.withColumn("bx", F.floor(F.col("x") / edge)).withColumn("by_", F.floor(F.col("y") / edge)), "cells")
    low = F.min("s").over(W.partitionBy(*by, "bx", "by_"))
    top = cells.withColumn("low", low).where(F.col("s") == F.col("low")).drop("low")
    near = F.sequence(F.lit(-1), F.lit(1))
    probe = top.withColumn("i", F.explode(near)).withColumn("j", F.explode(near)).select(
        *by, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("s").alias("s1"), F.col("h").alias("h1"),
        (F.col("bx") + F.col("i")).alias("bx"), (F.col("by_") + F.col("j")).alias("by_"))
    beaten = grown(probe).join(cells, by + ["bx", "by_"]).where(
        (F.abs(F.col("x") - F.col("x1")) <= F.col("h1")) & (F.abs(F.col("y") - F.col("y1")) <= F.col("h1"))
        & (F.col("s") < F.col("s1"))).select(*by, F.col("x1").alias("x"), F.col("y1").alias("y")).distinct()
    keep = top.join(grown(beaten), by + ["x", "y"], "left_anti").select(*by, "x", "y", F.col("s").alias("score"))
    return df.join(grown(keep), by + ["x", "y", "score"], "left_semi")


def adaptive_minima(scores: DataFrame, group: list[str], by: list[str], half: Column, bias: float,
                    want: int = MINIMA_WANTED) -> DataFrame:
    """Local minima below the first of 100 rising cutoffs that admits ``want`` of them.

    Being a minimum does not depend on the cutoff, so the minima are found once and
    counted per cutoff; the last cutoff applies when none admits enough.
    """
    stats = measured(scores.groupBy(*group).agg((F.avg("score") - F.stddev_samp("score") * bias).alias("base")))
    mins = local_minima(scores, by, half).join(stats, group)
    limit = lambda k: F.col("base") + k * CUTOFF_STEP
    guess = F.greatest(F.floor((F.col("score") - F.col("base")) / CUTOFF_STEP) - 1, F.lit(0))
    first = F.when(F.col("score") < limit(guess), guess).when(F.col("score") < limit(guess + 1), guess + 1).when(
        F.col("score") < limit(guess + 2), guess + 2).otherwise(guess + 3)
    mins = mins.withColumn("k", first).where(F.col("k") < CUTOFF_STEPS)
    count = mins.groupBy(*group, "k").agg(F.count("*").alias("n"))
    w = W.partitionBy(*group).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    reach = count.withColumn("cum", F.sum("n").over(w)).groupBy(*group).agg(
        F.coalesce(F.min(F.when(F.col("cum") >= want, F.col("k"))), F.lit(CUTOFF_STEPS - 1)).alias("stop"))
    return mins.join(reach, group).where(F.col("k") <= F.col("stop")).select(*scores.columns)


def dedupe_candidates(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates((by or KEY) + ["x", "y"])


def ring() -> list[tuple[int, int]]:
    """The 28 cells around the inner square, walked from its upper left corner."""
    low, n = RING_LOW, RING_HIGH - RING_LOW
    sides = [((low + k, low), (low + n, low + k), (low + n - k, low + n), (low, low + n - k)) for k in range(n)]
    return [sides[k][i] for i in range(4) for k in range(n)]


def ring_pick(seed: int, pair: Column) -> Column:
    """0 or 1, the same on every run: which cell of a ring pair a minimum examines."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in (*KEY, "x", "y")], pair.cast("string"), F.lit(str(seed)))
    return F.when(F.substring(F.md5(text), 1, 1) < "8", 0).otherwise(1)


def refine_candidates(minima: DataFrame, seed: int = 7) -> DataFrame:
    """Candidates of the next finer level around each minimum: the inner square, and one
    cell of every two consecutive ring cells."""
    inner = [(i, j) for i in range(-SEARCH_REACH, SEARCH_REACH + 1) for j in range(-SEARCH_REACH, SEARCH_REACH + 1)]
    pt = lambda i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
    cells = ring()
    picks = [F.when(ring_pick(seed, F.lit(p)) == 0, pt(*cells[2 * p])).otherwise(pt(*cells[2 * p + 1]))
             for p in range(len(cells) // 2)]
    m = minima.select(*KEY, "x", "y").distinct()
    moves = m.withColumn("d", F.explode(F.array(*[pt(*d) for d in inner], *picks)))
    return moves.select(*KEY, (F.col("x") * 2 + F.col("d.i")).alias("x"), (F.col("y") * 2 + F.col("d.j")).alias("y")).distinct()
