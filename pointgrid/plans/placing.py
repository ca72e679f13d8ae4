"""Coarse-to-fine placement of scans on a floor plan, plan doors and the scale search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import filters, grids, placement
from ..operators.graph import top_per
from ..stages import cut, grown

# Fixed values of the placement run.
LEVELS = 5
PLAN_CONFIDENCE, SCAN_CONFIDENCE = 0.4, 0.75
SCAN_RECTS, DOOR_RECTS = 1536.0, 256.0
DOOR_LEVELS = 3
BIAS_TOP, BIAS, BIAS_DOOR_FINE = 1.5, 1.2, -0.5
KEY = ["scan_id", "rot"]


def plan_sheets(plan: DataFrame, rows: int, cols: int, levels: int = LEVELS, erosion: bool = True) -> DataFrame:
    """Plan pyramid ``(level, row, col, p, pe, inside)`` from a confidence table."""
    eroded = grids.erode(plan, [], rows, cols) if erosion else plan
    fine = filters.confident(plan.select("row", "col", "value"), PLAN_CONFIDENCE)
    pyr = grids.pyramid(fine, levels, [])
    pyr_e = grids.pyramid(filters.confident(eroded.select("row", "col", "value"), PLAN_CONFIDENCE), levels, [])
    inside = grids.inside_mask(pyr, ["level"])
    return placement.sheet(pyr, pyr_e, inside, ["level"])


def scan_templates(scans: DataFrame, masks: DataFrame, rows: int, cols: int, levels: int = LEVELS,
                   erosion: bool = True) -> tuple[DataFrame, DataFrame]:
    """Trimmed templates of every level, and their extents ``(scan_id, rot, level, ...)``."""
    by = KEY + ["level"]
    eroded = grids.erode(scans, KEY, rows, cols) if erosion else scans
    pyr = filters.confident(grids.pyramid(scans, levels, KEY), SCAN_CONFIDENCE)
    pyr_e = filters.confident(grids.pyramid(eroded.select(*scans.columns), levels, KEY), SCAN_CONFIDENCE)
    ext = cut(grids.extent(pyr, by), "extent")
    trimmed = [grids.trim(t, ext, by) for t in (pyr, pyr_e, grids.pyramid(masks, levels, KEY))]
    return placement.template(*trimmed, by=by), ext


def search(sheets: DataFrame, sizes: tuple[int, int], templates: DataFrame, extents: DataFrame, levels: int,
           rects: float, bias, doors: DataFrame | None = None, response: DataFrame | None = None,
           seed: int = 7) -> DataFrame:
    """Level loop shared by scans and door symbols: score, keep minima, refine.

    ``sizes`` is the plan's (rows, cols); ``bias(level)`` the cutoff bias. All scans
    advance together; each level is stored before the next one starts. Runs jobs.
    """
    sheets, templates, extents = cut(sheets, "sheets"), cut(templates, "templates"), cut(extents, "extents")
    cands = best = None
    for level in range(levels, -1, -1):
        rows, cols = (grids.pyramid_size(n, level) for n in sizes)
        ext = extents.where(F.col("level") == level).select(
            *KEY, (F.col("max_row") - F.col("min_row") + 1).alias("rows"), (F.col("max_col") - F.col("min_col") + 1).alias("cols"))
        tmpl = templates.where(F.col("level") == level).drop("level")
        fits = placement.initial_candidates(ext, rows, cols) if cands is None else grown(cands).join(ext, KEY).where(
            (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < cols - F.col("cols")) & (F.col("y") < rows - F.col("rows"))
        ).select(*KEY, "x", "y")
        sums = placement.correlate(fits, tmpl, sheets.where(F.col("level") == level).drop("level"))
        sums = filters.gate_candidates(sums)
        if doors is None:
            sums = sums.withColumns({"door_uxp": F.lit(0.0), "door_count": F.lit(1.0)})
        else:
            at = response.where(F.col("level") == level).drop("level")
            sums = placement.door_agreement(sums, placement.doors_at_level(doors, level), at)
        scores = cut(placement.score_candidates(sums), "scores")
        least = ext.groupBy("scan_id").agg(
            F.floor((F.min("rows") + F.min("cols")) / (2.0 * math.sqrt(rects)) / 2.0).cast("int").alias("half"))
        mins = placement.adaptive_minima(scores.join(least, "scan_id"), ["scan_id"], KEY, F.col("half"), bias(level))
        best = cut(mins.select(*scores.columns), "minima")
        cands = placement.refine_candidates(best, seed)
    return best


def place_scans(plan: DataFrame, sizes: tuple[int, int], scans: DataFrame, masks: DataFrame, scan_size: tuple[int, int],
                doors: DataFrame | None = None, response: DataFrame | None = None, levels: int = LEVELS,
                erosion: bool = True, strict_level0: bool = False, seed: int = 7) -> DataFrame:
    """Ranked placements of every scan. Confidence tables in, ``strict_level0`` applies
    the looser cutoff at the finest level that the established procedure overrides."""
    sheets = plan_sheets(plan, *sizes, levels, erosion)
    templates, ext = scan_templates(scans, masks, *scan_size, levels, erosion)
    bias = lambda k: BIAS_TOP if k == levels else BIAS_DOOR_FINE if strict_level0 and k == 0 else BIAS
    return search(sheets, sizes, templates, ext, levels, SCAN_RECTS, bias, doors, response, seed)


def clean_plan(grey: DataFrame) -> DataFrame:
    """Plan cells without the components smaller than average. ``grey`` is ``(scan_id, row, col, grey)``."""
    labelled = grids.components(grey.where("grey <> 255"), ["scan_id"])
    return grids.drop_small_components(labelled, ["scan_id"]).drop("comp")


def plan_front(grey: DataFrame, rows: int, cols: int) -> tuple[DataFrame, int, int]:
    """Confidence cells of plan images, cleaned and centred in a larger sheet, and the sheet's size.

    ``grey`` is ``(scan_id, row, col, grey)`` with one image per ``scan_id``. Runs jobs.
    """
    padded, rows, cols = grids.pad_cells(clean_plan(grey), rows, cols)
    return grids.grey_to_cells(padded), rows, cols


def place_on_image(grey: DataFrame, sizes: tuple[int, int], *scans, **options) -> DataFrame:
    """``place_scans`` on one plan image ``(row, col, grey)``; positions count from the corner of the larger sheet.

    Door responses among the options belong to that sheet too. Runs jobs.
    """
    plan, rows, cols = plan_front(grey.withColumn("scan_id", F.lit(0)), *sizes)
    return place_scans(cut(plan.drop("scan_id"), "plan"), (rows, cols), *scans, **options)


def door_symbols(symbol: DataFrame, rows: int, cols: int) -> DataFrame:
    """Eight templates of a door symbol: four quarter turns, each also mirrored.

    Returns ``scan_id (0), rot 0..7, row, col, value, height, width, ox, oy`` where
    (ox, oy) points from the symbol toward the door.
    """
    # Turn -> (row, col) of a cell, size, direction of the door.
    r, c = F.col("row"), F.col("col")
    turns = [(r, c, rows, cols, 1, 0), (cols - 1 - c, r, cols, rows, 0, -1),
             (rows - 1 - r, cols - 1 - c, rows, cols, -1, 0), (c, rows - 1 - r, cols, rows, 0, 1)]
    parts = []
    for k, (nr, nc, h, w, dx, dy) in enumerate(turns):
        for flip in (0, 1):
            parts.append(F.struct(
                F.lit(2 * k + flip).alias("rot"), nr.alias("row"), (w - 1 - nc if flip else nc).alias("col"),
                F.lit(h).alias("height"), F.lit(w).alias("width"),
                F.lit(-dx if flip else dx).alias("ox"), F.lit(dy).alias("oy")))
    return symbol.select("value", F.explode(F.array(*parts)).alias("t")).select(
        F.lit(0).alias("scan_id"), "t.rot", "t.row", "t.col", "value", "t.height", "t.width", "t.ox", "t.oy")


def plan_doors(plan: DataFrame, sizes: tuple[int, int], symbol: DataFrame, symbol_size: tuple[int, int],
               levels: int = DOOR_LEVELS, out_levels: int = LEVELS, seed: int = 7) -> DataFrame:
    """Door response of a plan: ``(level, row, col, value)``, 2 on doors, 1 on open floor.

    ``plan`` is a confidence table; cells without confidence count as white floor.
    """
    sym = door_symbols(symbol, *symbol_size)
    shape = sym.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("height", "width", "ox", "oy")])
    pyr = grids.pyramid(sym.select(*KEY, "row", "col", "value"), levels, KEY)
    half = lambda c: F.expr(f"aggregate(sequence(1, level), {c}, (n, i) -> cast(floor(n / 2) + 1 as int))")
    per = shape.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    per = per.withColumns({k: F.when(F.col("level") == 0, F.col(k)).otherwise(half(k)) for k in ("height", "width")})
    full = per.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).select(*KEY, "level", "row", "col")
    templates = placement.template(pyr, pyr, full, by=KEY + ["level"])
    ext = per.select(*KEY, "level", F.lit(0).alias("min_row"), (F.col("height") - 1).alias("max_row"),
                     F.lit(0).alias("min_col"), (F.col("width") - 1).alias("max_col"))
    bias = lambda k: BIAS_DOOR_FINE if k == 0 else BIAS
    found = search(plan_sheets(plan, *sizes, levels), sizes, templates, ext, levels, DOOR_RECTS, bias, seed=seed)
    good = filters.accept_below(found).join(shape, KEY)
    stamp = good.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    stamp = stamp.select(
        G.trunc(F.col("j") + F.col("y") + F.col("oy") * F.col("height") / 2.0).alias("row"),
        G.trunc(F.col("i") + F.col("x") + F.col("ox") * F.col("width") / 2.0).alias("col"), F.lit(2.0).alias("value"))
    stamp = filters.clip(stamp, {"row": (0, sizes[0]), "col": (0, sizes[1])})
    white = plan.sparkSession.range(sizes[0] * sizes[1]).select(
        F.floor(F.col("id") / sizes[1]).cast("int").alias("row"), (F.col("id") % sizes[1]).cast("int").alias("col"))
    white = white.join(plan.select("row", "col"), ["row", "col"], "left_anti").withColumn("value", F.lit(1.0))
    response = stamp.unionByName(white).groupBy("row", "col").agg(F.max("value").alias("value"))
    return grids.pyramid(response, out_levels, [])


def find_scale(score_at, start: float, delta: float = 0.5, step: float = 0.1, stop: float = 0.0001) -> float:
    """Plan scale with the lowest best score.

    ``score_at(scales) -> DataFrame(scale, score)`` places one scan at each scale. Three
    neighbouring scales slide toward the better side; once the middle is best the
    spacing shrinks.
    """
    known: dict[float, float] = {}
    mid = start
    while delta > stop:
        trio = [round(mid + k * delta, 6) for k in (-1, 0, 1)]
        new = [s for s in trio if s not in known]
        if new:
            rows = top_per(score_at(new), ["scale"], [F.col("score")], 1).select("scale", "score").collect()
            known.update({round(r["scale"], 6): r["score"] for r in rows})
        low, centre, high = (known.get(s, math.inf) for s in trio)
        if low < centre and (low < high or not high < centre):
            mid = trio[0]
        elif high < centre:
            mid = trio[2]
        else:
            delta -= step
    return mid
