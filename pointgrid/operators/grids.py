"""Cell tables: rasters, pooling, morphology, gap fill, masks and components.

A cell table is ``(scan_id, [rot,] [level,] row, col, value)``; ``by`` names the
columns that separate grids. Neighbourhood steps are separable (rows, then columns),
so a k x k window costs 2k rows per cell instead of k^2.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..stages import cut, grown, measured

FILL_BLOCK = 4096


def offsets(reach: int, dims: int) -> list[tuple[int, ...]]:
    return list(itertools.product(range(-reach, reach + 1), repeat=dims))


def steps(low: int, high: int) -> Column:
    return F.sequence(F.lit(low), F.lit(high))


def coo_encode(cells: DataFrame, rows: int) -> DataFrame:
    """(row, col) -> column-major linear index."""
    rest = [c for c in cells.columns if c not in ("row", "col")]
    return cells.select(*rest, (F.col("col").cast("long") * rows + F.col("row")).alias("index"))


def coo_decode(df: DataFrame, rows: int) -> DataFrame:
    rest = [c for c in df.columns if c != "index"]
    return df.select(*rest, (F.col("index") % rows).cast("int").alias("row"),
                     F.floor(F.col("index") / rows).cast("int").alias("col"))


def grey_to_cells(img: DataFrame) -> DataFrame:
    rest = [c for c in img.columns if c != "grey"]
    return img.where(F.col("grey") != 255).select(*rest, (1.0 - F.col("grey") / 255.0).alias("value"))


def cells_to_grey(cells: DataFrame, by: list[str]) -> DataFrame:
    """Inverse of ``grey_to_cells``, scaled by each grid's largest value."""
    top = cells.groupBy(*by).agg(F.max("value").alias("_top"))
    rest = [c for c in cells.columns if c != "value"]
    grey = G.trunc(255.0 - F.col("value") * 255.0 / F.nullif(F.col("_top"), F.lit(0.0)))
    return cells.join(measured(top), by).select(*[cells[c] for c in rest], grey.alias("grey"))


def rasterise(points: DataFrame, rows: int, cols: int, by: list[str]) -> DataFrame:
    """Colour and range of the last point (by ``idx``) that falls on each panorama cell."""
    px, py, r = G.pano_xy(G.vec(), cols, rows)
    p = points.select(*by, "idx", "r", "g", "b", G.trunc(py).alias("row"), G.trunc(px).alias("col"), r.alias("depth"))
    p = p.where((F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0))
    p = p.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    last = F.max_by(F.struct("r", "g", "b", "depth"), "idx").alias("v")
    return p.groupBy(*by, "row", "col").agg(last).select(*by, "row", "col", "v.*")


def block_mean(cells: DataFrame, by: list[str], n: int = 8) -> DataFrame:
    """Mean of the non-empty cells of each n x n block."""
    return cells.where(F.col("value") != 0).groupBy(
        *by, F.floor(F.col("row") / n).cast("int").alias("row"), F.floor(F.col("col") / n).cast("int").alias("col")
    ).agg(F.avg("value").alias("value"))


def block_mean_normal(cells: DataFrame, by: list[str], n: int = 8) -> DataFrame:
    """Unit mean normal of each n x n block; blocks that cancel out are dropped."""
    s = cells.groupBy(
        *by, F.floor(F.col("row") / n).cast("int").alias("row"), F.floor(F.col("col") / n).cast("int").alias("col")
    ).agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    size = G.norm(G.vec("n"))
    return s.where(size > 0).select(*by, "row", "col", *[(F.col(f"n{a}") / size).alias(f"n{a}") for a in "xyz"])


def pyramid(cells: DataFrame, levels: int, by: list[str]) -> DataFrame:
    """Max-pooled grids for level 0..levels in one aggregation."""
    p = cells.withColumn("level", F.explode(steps(0, levels)))
    div = lambda c: F.expr(f"shiftright(`{c}`, level)")
    return p.select(*by, "level", div("row").alias("row"), div("col").alias("col"), "value").groupBy(
        *by, "level", "row", "col").agg(F.max("value").alias("value"))


def pyramid_size(n: int, level: int) -> int:
    """Rows or columns of a pyramid level; each level has half plus one."""
    for _ in range(level):
        n = n // 2 + 1
    return n


def extent(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(
        F.min("row").alias("min_row"), F.max("row").alias("max_row"),
        F.min("col").alias("min_col"), F.max("col").alias("max_col"))


def trim(cells: DataFrame, ext: DataFrame, by: list[str]) -> DataFrame:
    """Cells inside the extent, moved to its corner."""
    t = cells.join(measured(ext), by).where(
        F.col("row").between(F.col("min_row"), F.col("max_row")) & F.col("col").between(F.col("min_col"), F.col("max_col")))
    rest = [c for c in cells.columns if c not in ("row", "col")]
    return t.select(*rest, (F.col("row") - F.col("min_row")).alias("row"), (F.col("col") - F.col("min_col")).alias("col"))


def move_origin(zero_zero: DataFrame, ext: DataFrame, by: list[str]) -> DataFrame:
    """Scanner pixel after trimming."""
    return zero_zero.join(ext, by).select(
        *by, (F.col("zx") - F.col("min_col")).alias("zx"), (F.col("zy") - F.col("min_row")).alias("zy"))


def pad_cells(cells: DataFrame, rows: int, cols: int, factor: float = 1.1) -> tuple[DataFrame, int, int]:
    """Centre the plan in a larger sheet; returns the cells and the new size."""
    new_rows, new_cols = int(rows * factor), int(cols * factor)
    dr, dc = (new_rows - rows) // 2, (new_cols - cols) // 2
    return cells.withColumn("row", F.col("row") + dr).withColumn("col", F.col("col") + dc), new_rows, new_cols


def _along(cells: DataFrame, by: list[str], axis: str, low: int, high: int, size: int, *aggs: Column) -> DataFrame:
    other = "col" if axis == "row" else "row"
    e = cells.withColumn("_o", F.explode(steps(low, high))).withColumn(axis, F.col(axis) + F.col("_o"))
    return e.where(F.col(axis).between(0, size - 1)).groupBy(*by, axis, other).agg(*aggs)


def erode(cells: DataFrame, by: list[str], rows: int, cols: int, n: int = 5) -> DataFrame:
    """Dark grows: every cell takes the largest confidence of its n x n window."""
    h = n // 2
    top = F.max("value").alias("value")
    return _along(_along(cells, by, "row", -h, h, rows, top), by, "col", -h, h, cols, top).select(
        *by, "row", "col", "value")


def dilate(cells: DataFrame, by: list[str], rows: int, cols: int, n: int = 5) -> DataFrame:
    """Dark shrinks: a cell stays only if its whole window (inside the image) is filled."""
    h = n // 2

    def shrink(df: DataFrame, axis: str, size: int) -> DataFrame:
        out = _along(df, by, axis, -h, h, size, F.min("value").alias("value"), F.count("*").alias("_k"))
        room = F.least(F.col(axis) + h, F.lit(size - 1)) - F.greatest(F.col(axis) - h, F.lit(0)) + 1
        return out.where(F.col("_k") == room).select(*by, "row", "col", "value")

    return shrink(shrink(cells, "row", rows), "col", cols)


def erode_sparse(cells: DataFrame, by: list[str], rows: int, cols: int) -> DataFrame:
    """Largest value among a cell, its left, its upper and its upper-left neighbour."""
    top = F.max("value").alias("value")
    out = _along(_along(cells, by, "row", 0, 1, rows, top), by, "col", 0, 1, cols, top)
    return out.where(F.col("value") != 0).select(*by, "row", "col", "value")


def local_mean(cells: DataFrame, by: list[str], n: int = 11) -> DataFrame:
    """Mean of the non-zero cells of the n x n window around each existing cell.

    Rows are summed by offset, columns by a range window over one grid column.
    """
    h = n // 2
    e = cells.withColumn("_o", F.explode(steps(-h, h)))
    used = F.col("value").isNotNull() & (F.col("value") != 0)
    side = e.groupBy(*by, "row", (F.col("col") + F.col("_o")).alias("col")).agg(
        F.coalesce(F.sum(F.when(used, F.col("value"))), F.lit(0.0)).alias("_s"),
        F.count(F.when(used, 1)).alias("_n"), F.max(F.col("_o") == 0).alias("_own"))
    w = W.partitionBy(*by, "col").orderBy("row").rangeBetween(-h, h)
    out = side.withColumn("_ts", F.sum("_s").over(w)).withColumn("_tn", F.sum("_n").over(w)).where("_own")
    mean = F.when(F.col("_tn") > 0, F.col("_ts") / F.col("_tn")).otherwise(F.lit(0.0))
    return out.select(*by, "row", "col", mean.alias("local_mean"))


def inside_mask(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells between the first and last filled cell of both their column and their row."""
    col = cells.groupBy(*by, "col").agg(F.min("row").alias("r0"), F.max("row").alias("r1"))
    row = cells.groupBy(*by, "row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    filled = col.select(*by, "col", F.explode(F.sequence("r0", "r1")).alias("row"))
    return filled.join(row, by + ["row"]).where(F.col("col").between(F.col("c0"), F.col("c1"))).select(*by, "row", "col")


def _carry(cells: DataFrame, by: list[str], pos: Column, source: str, limit: int, forward: bool,
           ends: tuple[Column, Column, Column]) -> DataFrame:
    """Adds ``_c``: the source value carried from at most ``limit`` positions away.

    The dense grid is read in blocks of positions; a cell near the end of a block also
    visits the next block, since a carry cannot reach further. Cells before the very
    first source cell take that cell's value, again for ``limit`` positions. ``ends``
    holds the first position, the first source position and its value.
    """
    at = (pos if forward else -pos).cast("long")
    block = F.floor(F.col("_pos") / FILL_BLOCK)
    near_end = (F.pmod(F.col("_pos"), F.lit(FILL_BLOCK)) >= FILL_BLOCK - limit) & F.col(source).isNotNull()
    visits = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    rows = cells.withColumn("_pos", at).withColumn("_home", F.floor(F.col("_pos") / FILL_BLOCK)).withColumn("_b", F.explode(visits))
    w = W.partitionBy(*by, "_b").orderBy("_pos").rangeBetween(-limit, 0)
    out = rows.withColumn("_c", F.last(source, ignorenulls=True).over(w)).where(F.col("_b") == F.col("_home"))
    start, first, value = ends
    before = (F.col("_pos") < first) & (F.col("_pos") < start + limit)
    return out.withColumn("_c", F.when(before, value).otherwise(F.col("_c"))).drop("_pos", "_b", "_home")


def _ends(df: DataFrame, by: list[str], orders: list[Column], source: str) -> DataFrame:
    """First and last position and source cell of each grid, for every scan order."""
    has, aggs = F.col(source).isNotNull(), []
    for k, pos in enumerate(orders):
        at = F.when(has, pos)
        aggs += [F.min(pos).alias(f"_lo{k}"), F.max(pos).alias(f"_hi{k}"), F.min(at).alias(f"_p{k}"), F.max(at).alias(f"_q{k}"),
                 F.min_by(source, at).alias(f"_v{k}"), F.max_by(source, at).alias(f"_w{k}")]
    return df.groupBy(*by).agg(*aggs)


def fill_gaps(cells: DataFrame, by: list[str], limit: int = 15, chained: bool = False,
              value: str = "value") -> DataFrame:
    """Fill empty cells of a dense grid from four directional carries.

    ``value`` NULL marks an empty cell. The carries run row by row forward and
    backward, then column by column forward and backward, cross line ends, and reach
    ``limit`` cells. Plain mode: only original cells are sources and later passes win.
    ``chained``: filled cells become sources for the following passes, so each pass
    only fills what is still empty; the passes are stored in between. Cells are
    ``(by, row, col, value)`` and complete.
    """
    size = cells.groupBy(*by).agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))
    out = cells.join(measured(size), by).withColumn("_orig", F.col(value))
    row_major = F.col("row").cast("long") * F.col("_cols") + F.col("col")
    col_major = F.col("col").cast("long") * F.col("_rows") + F.col("row")
    source = value if chained else "_orig"
    if chained:
        out = cut(out, "gaps")
    plain = None if chained else measured(_ends(out, by, [row_major, col_major], source))
    for k, (pos, forward) in enumerate([(row_major, True), (row_major, False), (col_major, True), (col_major, False)]):
        ends = _ends(out, by, [row_major, col_major], source) if chained else plain
        o = k // 2
        pick = [F.col(f"_lo{o}"), F.col(f"_p{o}"), F.col(f"_v{o}")] if forward else [-F.col(f"_hi{o}"), -F.col(f"_q{o}"), F.col(f"_w{o}")]
        out = out.join(ends.select(*by, *[c.alias(n) for c, n in zip(pick, ("_e0", "_e1", "_e2"))]), by)
        out = _carry(out, by, pos, source, limit, forward, (F.col("_e0"), F.col("_e1"), F.col("_e2"))).drop("_e0", "_e1", "_e2")
        if chained:
            out = cut(out.withColumn(value, F.coalesce(F.col(value), F.col("_c"))).drop("_c"), "gaps")
        else:
            out = out.withColumn(value, F.coalesce("_orig", "_c", value)).drop("_c")
    return out.select(*by, "row", "col", value)


def components(cells: DataFrame, by: list[str], max_rounds: int = 64) -> DataFrame:
    """8-connected components: adds ``comp``, the smallest cell number of the component.

    Neighbour links are contracted to stars by alternating large-star and small-star
    rounds, which need about log(n) rounds whatever the shape. Only minima are
    aggregated, so a component that holds most cells is never gathered. Runs jobs.
    """
    node = F.col("row").cast("long") * (1 << 31) + F.col("col")
    nodes = cells.select(*by, "row", "col", node.alias("u"))
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ends = nodes.withColumn("o", F.explode(moves)).select(
        *by, F.col("u"), ((F.col("row") + F.col("o.r")).cast("long") * (1 << 31) + F.col("col") + F.col("o.c")).alias("v"))
    edges = cut(grown(ends).join(nodes.select(*by, F.col("u").alias("v")), by + ["v"], "left_semi").select(*by, "u", "v"), "links")
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*by, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(grown(low), by + ["u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u > v")
        low2 = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(grown(low2), by + ["u"]).where("v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low2.select(*by, "u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = cut(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    # Links of neighbouring cells take few bytes when stored, so their size there says little about their rows.
    return nodes.join(grown(edges.select(*by, "u", F.col("v").alias("comp"))), by + ["u"], "left").join(
        grown(cells), by + ["row", "col"]).select(*cells.columns, F.coalesce("comp", "u").alias("comp"))


def drop_small_components(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Remove components smaller than the average component of their grid."""
    size = labelled.groupBy(*by, "comp").agg(F.count("*").alias("_n"))
    mean = size.groupBy(*by).agg(F.avg("_n").alias("_m"))
    small = size.join(mean, by).where(F.col("_n") < F.col("_m")).select(*by, "comp")
    return labelled.join(grown(small), by + ["comp"], "left_anti")


def coverage(placed: DataFrame, cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Plan pixels painted and seen by the chosen placements.

    ``placed`` has ``node_id, scan_id, rot, x, y, zx, zy``; ``cells`` has ``kind``
    ('scan' or 'mask'). The painter of a pixel is the last node in id order.
    """
    p = placed.join(cells, ["scan_id", "rot"]).select(
        "node_id", "kind", (F.col("row") + F.col("y") - F.col("zy")).alias("row"),
        (F.col("col") + F.col("x") - F.col("zx")).alias("col"))
    p = p.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    paint = F.when(F.col("kind") == "scan", F.col("node_id"))
    return p.groupBy("row", "col").agg(
        F.count(paint).alias("n_painted"), F.max(paint).alias("painter"),
        F.max((F.col("kind") == "mask").cast("int")).alias("seen"))


def descriptor_distance(pairs: DataFrame, rows: int, cols: int) -> DataFrame:
    """L2 distance of paired descriptors placed at the first keypoint, with its z-score.

    ``pairs`` has ``row, col, seq, a, b``; the last pair on a pixel wins. The mean is
    over non-zero pixels; the deviation also counts every empty pixel of the
    rows x cols image as a zero, divided by the number of non-zero pixels.
    """
    d = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)),
                           F.lit(0.0), lambda s, v: s + v))
    cells = pairs.select("row", "col", "seq", d.alias("d")).groupBy("row", "col").agg(
        F.max_by("d", "seq").alias("dist")).where((F.col("dist") != 0) & ~F.isnan("dist"))
    n, mean = F.count("*"), F.avg("dist")
    stats = cells.agg(F.struct(mean.alias("m"), F.sqrt(
        F.var_pop("dist") + (F.lit(float(rows * cols)) - n) * mean * mean / n).alias("s")).alias("st"))
    st = stats.scalar()
    return cells.withColumn("z", (F.col("dist") - st["m"]) / F.nullif(st["s"], F.lit(0.0)))
