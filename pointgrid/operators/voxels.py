"""Voxel tables: occupancy, free space, rotation, comparison and merging.

A voxel table is ``(scan_id, [rot,] [kind,] vx, vy, vz [, n])``; an absent row is an
empty voxel. ``box`` tables hold the limits ``x0..z1`` of each scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.colour import free_grey, point_grey
from ..functions.weights import sigmoid_weight
from ..stages import cut, measured, spread

SLABS = 100
FOLD_CHUNK = 4096
WORD = 63


def grid_frame(box: DataFrame, scale: float, slabs: int | None = SLABS) -> DataFrame:
    """Per-scan grid: cell counts ``nx, ny, nz``, vertical scale and scanner position.

    With ``slabs`` the height is cut into that many layers, otherwise the vertical
    scale equals ``scale``. ``side`` is the edge of the square that holds any
    rotation, ``dx, dy`` the margins added around the grid. The frame is stored.
    """
    size = lambda a, s: (s * (F.col(f"{a}1") - F.col(f"{a}0"))).cast("int")
    df = box.withColumn("zs", F.lit(float(slabs)) / (F.col("z1") - F.col("z0")) if slabs else F.lit(float(scale)))
    df = df.withColumn("nx", size("x", F.lit(float(scale)))).withColumn("ny", size("y", F.lit(float(scale))))
    df = df.withColumn("nz", F.lit(slabs) if slabs else size("z", F.col("zs")))
    side = (F.lit(math.sqrt(2.0)) * F.greatest("nx", "ny")).cast("int")
    df = df.withColumn("side", side)
    return measured(df.select(
        "scan_id", "x0", "y0", "z0", "zs", "nx", "ny", "nz", "side",
        ((F.col("side") - F.col("nx")) / 2.0).cast("int").alias("dx"),
        ((F.col("side") - F.col("ny")) / 2.0).cast("int").alias("dy"),
        (-F.col("x0") * scale).alias("ox"), (-F.col("y0") * scale).alias("oy"),
        (-F.col("z0") * F.col("zs")).alias("oz"), F.lit(float(scale)).alias("scale"),
    ))


def _voxel_of(points: DataFrame, frame: DataFrame) -> DataFrame:
    v = points.join(frame, "scan_id")
    v = v.withColumn("vx", G.quantise(F.col("x"), F.col("x0"), F.col("scale")))
    v = v.withColumn("vy", G.quantise(F.col("y"), F.col("y0"), F.col("scale")))
    v = v.withColumn("vz", G.quantise(F.col("z"), F.col("z0"), F.col("zs")))
    return v.where(inside("vx", "vy", "vz"))


def inside(x: str, y: str, z: str) -> Column:
    ok = F.lit(True)
    for c, n in ((x, "nx"), (y, "ny"), (z, "nz")):
        ok = ok & (F.col(c) >= 0) & (F.col(c) < F.col(n))
    return ok


def occupancy(points: DataFrame, frame: DataFrame) -> DataFrame:
    """Occupied voxels, once each."""
    return _voxel_of(points, frame).select("scan_id", "vx", "vy", "vz").distinct()


def voxel_count(points: DataFrame, frame: DataFrame) -> DataFrame:
    """Points per voxel."""
    return _voxel_of(points, frame).groupBy("scan_id", "vx", "vy", "vz").agg(F.count("*").alias("n"))


def nonzero(voxels: DataFrame, by: list[str]) -> DataFrame:
    return voxels.groupBy(*by).agg(F.count("*").alias("n_voxels"))


def voxel_running_mean(points: DataFrame, vpm: float = 50.0) -> DataFrame:
    """Depth per voxel as the running fold v <- (v + d) / 2 in ``idx`` order.

    The fold of a run of values is an affine map v -> v * 2^-n + s, and affine maps
    compose, so runs of consecutive ids are folded on their own and then joined,
    level by level, as often as the largest id asks for. A voxel that receives most of
    the points never gathers more than one chunk of ids in a task. The first value enters
    whole. Ids are not negative. Runs a job.
    """
    top = points.agg(F.max("idx")).first()[0] or 0
    levels = 1
    while top >= FOLD_CHUNK**levels:
        levels += 1
    depth = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    keys = ["scan_id", "vx", "vy", "vz"]
    runs = points.select(
        "scan_id", *[G.trunc(F.col(a) * vpm).alias(f"v{a}") for a in "xyz"],
        F.col("idx").alias("seq"), F.lit(0.5).cast("double").alias("gain"), (depth / 2.0).alias("shift"),
        depth.alias("first"))
    for _ in range(levels):
        runs = runs.groupBy(*keys, F.floor(F.col("seq") / FOLD_CHUNK).alias("seq_up")).agg(
            F.array_sort(F.collect_list(F.struct("seq", "gain", "shift", "first"))).alias("run"))
        start = F.struct(F.lit(1.0).alias("gain"), F.lit(0.0).alias("shift"))
        step = F.aggregate("run", start, lambda acc, r: F.struct(
            (acc["gain"] * r["gain"]).alias("gain"), (acc["shift"] * r["gain"] + r["shift"]).alias("shift")))
        runs = runs.withColumn("a", step).select(
            *keys, F.col("seq_up").alias("seq"), "a.gain", "a.shift", F.col("run")[0]["first"].alias("first"))
    # v0 = first makes the first step (first + first) / 2 = first.
    return runs.select(*keys, (F.col("first") * F.col("gain") + F.col("shift")).alias("depth"))


def _rays(voxels: DataFrame, frame: DataFrame, stop) -> DataFrame:
    """Unit steps from the scanner toward each voxel, clipped to the grid."""
    v = spread(voxels, "scan_id", "vx", "vy", "vz").join(frame, "scan_id")
    ray = tuple(F.col(f"v{a}") - F.col(f"o{a}") for a in "xyz")
    v = v.withColumn("len", G.norm(ray)).where(F.col("len") > 0)
    v = v.withColumn("last", stop(F.col("len")).cast("int")).where(F.col("last") >= 0)
    v = v.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("last"))))
    hit = [F.floor(F.col(f"o{a}") + F.col("a") * (r / F.col("len"))).cast("int").alias(f"h{a}")
           for r, a in zip(ray, "xyz")]
    return v.select(*[c for c in ("scan_id", "n") if c in voxels.columns], "nx", "ny", "nz", *hit).where(
        inside("hx", "hy", "hz"))


def free_mark(voxels: DataFrame, frame: DataFrame) -> DataFrame:
    """Voxels seen through by any ray, the hit voxel's surroundings included."""
    hits = _rays(voxels.select("scan_id", "vx", "vy", "vz"), frame, lambda n: F.ceil(n))
    return hits.select("scan_id", *[F.col(f"h{a}").alias(f"v{a}") for a in "xyz"]).distinct()


def free_count(voxels: DataFrame, frame: DataFrame) -> DataFrame:
    """How many points were seen through each voxel; rays stop well before the surface."""
    hits = _rays(voxels, frame, lambda n: F.floor(n * 0.85 - 3.0) - 1)
    return hits.groupBy("scan_id", *[F.col(f"h{a}").alias(f"v{a}") for a in "xyz"]).agg(F.sum("n").alias("n"))


def rotate_grid(voxels: DataFrame, frame: DataFrame, rotations: DataFrame, mode: str = "round") -> DataFrame:
    """Resample voxels into each rotation's square grid.

    A target cell t reads the source cell at round(R (t - z1) + z0) (``trunc`` mode:
    truncated). Instead of visiting every target cell, each source voxel proposes the
    cells inside the bounding box of its own image (two on average for an upright
    rotation) and keeps those that really read it, so the work follows the occupied
    voxels and nothing is joined or shuffled but the voxel rows.
    """
    extra = [c for c in voxels.columns if c not in ("scan_id", "vx", "vy", "vz")]
    rot = rotations.select("scan_id", "rot", "m", G.inverse3(F.col("m")).alias("mi"))
    reach = [(F.abs(r[0]) + F.abs(r[1]) + F.abs(r[2])) * 0.5 + 1e-6 for r in G.rows3(F.col("mi"))]
    turned = measured(frame.join(rot, "scan_id").select("*", *[h.alias(f"h{a}") for h, a in zip(reach, "xyz")]))
    v = voxels.join(turned, "scan_id")
    z0 = tuple(F.col(f"o{a}") for a in "xyz")
    z1 = (F.col("ox") + F.col("dx"), F.col("oy") + F.col("dy"), F.col("oz"))
    centre = 0.0 if mode == "round" else 0.5
    image = G.plus(G.rotate(tuple(F.col(f"v{a}") + centre - o for a, o in zip("xyz", z0)), F.col("mi")), z1)
    v = v.select("*", *[c.alias(f"c{a}") for c, a in zip(image, "xyz")])
    for a, size in (("x", "side"), ("y", "side"), ("z", "nz")):
        low = F.greatest(F.ceil(F.col(f"c{a}") - F.col(f"h{a}")), F.lit(0)).cast("int")
        high = F.least(F.floor(F.col(f"c{a}") + F.col(f"h{a}")), F.col(size) - 1).cast("int")
        v = v.withColumn(f"t{a}", F.explode(F.when(low <= high, F.sequence(low, high))))
    src = G.plus(G.rotate(tuple(F.col(f"t{a}") - z for a, z in zip("xyz", z1)), F.col("m")), z0)
    hit = F.lit(True)
    for s, a in zip(src, "xyz"):
        if mode == "round":
            hit = hit & (F.signum(s) * F.floor(F.abs(s) + 0.5) == F.col(f"v{a}"))
        else:
            hit = hit & (s >= 0) & (F.floor(s) == F.col(f"v{a}"))
    return v.where(hit).select("scan_id", "rot", *extra, *[F.col(f"t{a}").alias(f"v{a}") for a in "xyz"])


def collapse(voxels: DataFrame) -> DataFrame:
    """Occupied slabs per map cell, as a cell table."""
    keys = [c for c in ("scan_id", "rot") if c in voxels.columns]
    return voxels.groupBy(*keys, F.col("vy").alias("row"), F.col("vx").alias("col")).agg(
        F.count("*").cast("double").alias("value"))


def column_counts(points: DataFrame, frame: DataFrame, slabs: int = SLABS) -> DataFrame:
    """``collapse(occupancy(...))`` of upright slabs in one shuffle.

    Each map column keeps its occupied slabs as bits of a few integers, which combine
    before the shuffle; counting bits replaces the distinct voxels.
    """
    v = _voxel_of(points, frame)
    words = (slabs + WORD - 1) // WORD
    bit = F.expr(f"shiftleft(1L, vz % {WORD})")
    masks = [F.bit_or(F.when(F.floor(F.col("vz") / WORD) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"_m{k}") for k in range(words)]
    n = sum((F.bit_count(f"_m{k}") for k in range(1, words)), F.bit_count("_m0"))
    return v.groupBy("scan_id", F.col("vy").alias("row"), F.col("vx").alias("col")).agg(*masks).select(
        "scan_id", "row", "col", n.cast("double").alias("value"))


def evidence(cells: DataFrame, kind: str) -> DataFrame:
    """Grey evidence image of collapsed counts (``kind`` is 'point' or 'free')."""
    by = [c for c in ("scan_id", "rot") if c in cells.columns]
    stats = cells.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    grey = point_grey if kind == "point" else free_grey
    return cells.join(measured(stats), by).select(
        *by, "row", "col", grey(F.col("value"), F.col("_m"), F.col("_s")).alias("grey"))


def blacken_origin(grey: DataFrame, frame: DataFrame, radius: float = 0.3) -> DataFrame:
    """Force the disc around the scanner to full free-space confidence."""
    r2 = radius * F.col("scale") * F.col("scale")
    reach = F.sqrt(r2).cast("int")
    disc = frame.join(grey.select("scan_id", "rot").distinct(), "scan_id").select(
        "scan_id", "rot", "side", "scale", (F.col("ox") + F.col("dx")).cast("int").alias("cx"),
        (F.col("oy") + F.col("dy")).cast("int").alias("cy"),
        F.explode(F.sequence(-reach, reach)).alias("j"))
    half = F.sqrt(F.greatest(r2 - F.col("j") * F.col("j"), F.lit(0.0)))
    disc = disc.where(F.col("j") < F.sqrt(r2)).withColumn(
        "i", F.explode(F.sequence(-half.cast("int"), F.ceil(half).cast("int")))).where(F.col("i") < half)
    dark = disc.select("scan_id", "rot", (F.col("cy") + F.col("j")).alias("row"), (F.col("cx") + F.col("i")).alias("col"),
                       "side").where("row >= 0 AND col >= 0 AND row < side AND col < side").drop("side")
    both = grey.unionByName(dark.withColumn("grey", F.lit(0)))
    return both.groupBy("scan_id", "rot", "row", "col").agg(F.min("grey").alias("grey"))


def voxel_stats(voxels: DataFrame, by: list[str]) -> DataFrame:
    return voxels.groupBy(*by).agg(F.avg("n").alias("mean_n"), F.stddev_samp("n").alias("sigma_n"))


def trim_voxels(voxels: DataFrame, frame: DataFrame, px_per_m: float) -> tuple[DataFrame, DataFrame]:
    """Shift rotated point and free voxels to the extent of the point voxels.

    Returns the shifted voxels and one metadata row per scan and rotation.
    """
    by = ["scan_id", "rot"]
    ext = voxels.where("kind = 'point'").groupBy(*by).agg(
        *[f(f"v{a}").alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    ext = measured(ext)
    cut_v = voxels.join(ext, by)
    for a in "xyz":
        cut_v = cut_v.where(F.col(f"v{a}").between(F.col(f"lo{a}"), F.col(f"hi{a}"))).withColumn(
            f"v{a}", F.col(f"v{a}") - F.col(f"lo{a}"))
    meta = ext.join(frame, "scan_id").select(
        *by,
        (F.col("ox").cast("int") + F.col("dx") - F.col("lox")).alias("zx"),
        (F.col("oy").cast("int") + F.col("dy") - F.col("loy")).alias("zy"),
        (F.col("oz").cast("int") - F.col("loz")).alias("zz"),
        *[(F.col(f"hi{a}") - F.col(f"lo{a}") + 1).alias(f"n{a}") for a in "xyz"],
        F.col("scale").alias("vox_per_m"), F.lit(float(px_per_m)).alias("px_per_m"))
    return cut_v.select(*by, "kind", "vx", "vy", "vz"), meta


def voxel_columns(voxels: DataFrame, reach: int) -> DataFrame:
    """Voxels as upright columns: one row per ``(scan_id, rot, vx, vy, word)`` with the
    slabs of 63 as bits. ``p`` point, ``f`` free, ``d`` within ``reach`` cells of a point
    of the same slab."""
    keys = ["scan_id", "rot", "vx", "vy", "word"]
    none = F.lit(0).cast("long")
    bit = F.expr(f"shiftleft(1L, cast(pmod(vz, {WORD}) as int))")
    is_point = F.col("kind") == "point"
    own = voxels.withColumn("word", F.floor(F.col("vz") / WORD).cast("int")).groupBy(*keys).agg(
        F.bit_or(F.when(is_point, bit).otherwise(none)).alias("p"), F.bit_or(F.when(is_point, none).otherwise(bit)).alias("f"))
    step, still = F.sequence(F.lit(-reach), F.lit(reach)), F.array(F.lit(0))
    moves = F.when(F.col("p") != 0, step).otherwise(still)
    near = own.withColumn("i", F.explode(moves)).withColumn("j", F.explode(moves))
    home = (F.col("i") == 0) & (F.col("j") == 0)
    return near.select(
        "scan_id", "rot", (F.col("vx") + F.col("i")).alias("vx"), (F.col("vy") + F.col("j")).alias("vy"), "word",
        F.when(home, F.col("p")).otherwise(none).alias("p"), F.when(home, F.col("f")).otherwise(none).alias("f"),
        F.col("p").alias("d")).groupBy(*keys).agg(*[F.bit_or(c).alias(c) for c in "pfd"])


def _lowered(df: DataFrame, bits: list[str], low: str, top: str) -> DataFrame:
    """Move column bits down by ``low`` slabs and keep slabs 0..``top``.

    A shift that is no multiple of the word splits each word over two.
    """
    d = df.withColumn("_k", F.pmod(-F.col(low), F.lit(WORD)).cast("int")).withColumn("_half", F.explode(F.array(F.lit(0), F.lit(1))))
    d = d.withColumn("word", (F.floor((F.col("word") * WORD - F.col(low)) / WORD) + F.col("_half")).cast("int"))
    d = d.withColumn("_room", F.col(top) - F.col("word") * WORD + 1).where((F.col("word") >= 0) & (F.col("_room") > 0))
    full = (1 << WORD) - 1
    keep = F.expr(f"CASE WHEN _room >= {WORD} THEN {full}L ELSE shiftleft(1L, cast(_room as int)) - 1 END")
    moved = {b: F.expr(f"CASE WHEN _half = 0 THEN shiftleft({b}, _k) WHEN _k = 0 THEN 0L ELSE shiftrightunsigned({b}, {WORD} - _k) END").bitwiseAND(
        keep) for b in bits}
    return d.withColumns(moved).drop("_k", "_half", "_room")


def voxel_agreement(pairs: DataFrame, voxels: DataFrame, reach: int = 2) -> DataFrame:
    """Point and free-space agreement of node pairs inside their overlap.

    ``pairs`` has ``a, b``, the scan and rotation of both sides and ``box_a, box_b``
    (overlap relative to each side). Voxels are packed once into columns of slab bits;
    a pair moves both sides' columns into the frame of the overlap, one aggregation per
    (pair, column) brings them together, and all counts are bit counts. A point counts
    as agreeing when the other side has a point within ``reach`` cells in the same
    slab. Slabs empty on one side are skipped. Runs a job.
    """
    columns = cut(voxel_columns(voxels, reach), "columns")
    used = columns.groupBy("scan_id", "rot", "word").agg(F.bit_or(F.col("p").bitwiseOR(F.col("f"))).alias("u"))
    ends = lambda s: pairs.select("a", "b", F.col(f"scan_{s}").alias("scan_id"), F.col(f"rot_{s}").alias("rot"), F.col(f"box_{s}").alias("box"),
                                  F.col(f"box_{s}.z1").alias("z1"), (F.col(f"box_{s}.z2") - F.col(f"box_{s}.z1")).alias("mz"))

    def side(s: str) -> DataFrame:
        v = ends(s).join(columns, ["scan_id", "rot"])
        for n in "xy":
            v = v.where(F.col(f"v{n}").between(F.col(f"box.{n}1"), F.col(f"box.{n}2")))
        v = _lowered(v, ["p", "f", "d"], "z1", "mz")
        own, other = ("a", "b") if s == "a" else ("b", "a")
        none = F.lit(0).cast("long")
        return v.where("p <> 0 OR f <> 0 OR d <> 0").select(
            "a", "b", *[(F.col(f"v{n}") - F.col(f"box.{n}1")).alias(f"u{n}") for n in "xy"], "word",
            *[F.col(c).alias(f"{c}{own}") for c in "pfd"], *[none.alias(f"{c}{other}") for c in "pfd"])

    def slabs(s: str) -> DataFrame:
        u = _lowered(ends(s).join(used, ["scan_id", "rot"]), ["u"], "z1", "mz")
        return u.groupBy("a", "b", "word").agg(F.bit_or("u").alias(f"u{s}"))

    names = ["pa", "pb", "fa", "fb", "da", "db"]
    cell = side("a").unionByName(side("b")).groupBy("a", "b", "ux", "uy", "word").agg(*[F.bit_or(n).alias(n) for n in names])
    both = slabs("a").join(slabs("b"), ["a", "b", "word"]).select("a", "b", "word", F.col("ua").bitwiseAND(F.col("ub")).alias("u"))
    cell = cell.join(measured(both), ["a", "b", "word"])
    c = {n: F.col(n).bitwiseAND(F.col("u")) for n in names}
    count = lambda bits: F.sum(F.bit_count(bits)).cast("long")
    total = lambda *ns: F.sum(sum((F.bit_count(c[n]) for n in ns[1:]), F.bit_count(c[ns[0]]))).cast("long")
    return cell.groupBy("a", "b").agg(
        count(c["da"].bitwiseAND(c["pb"]).bitwiseOR(c["pa"].bitwiseAND(c["db"]))).alias("agree"),
        count(c["pa"].bitwiseAND(c["fb"])).alias("free_a"), count(c["pb"].bitwiseAND(c["fa"])).alias("free_b"),
        count(c["fa"].bitwiseAND(c["fb"])).alias("free_cross"), total("pa").alias("total_a"), total("pb").alias("total_b"),
        total("pa", "pb", "fa", "fb").alias("total"))


def agreement_edges(agreement: DataFrame, meta: DataFrame) -> DataFrame:
    """Weight and significance of 3D edges. ``meta`` has ``a, b, c_sum`` where c_sum is
    the number of kept voxels of both kinds on both sides."""
    pa, pb = F.col("total_a"), F.col("total_b")
    mean = (pa + pb) / 2.0
    return agreement.where((pa > 0) & (pb > 0)).join(meta, ["a", "b"]).select(
        "a", "b",
        (F.col("agree") / mean - (F.col("free_b") / pb + F.col("free_a") / pa)).alias("w"),
        sigmoid_weight(F.col("total"), F.col("c_sum") / 2.0 * 0.5).alias("w_sig"),
        (F.col("agree") / mean).alias("p_a"), (F.col("free_a") / pa).alias("fe_a"), (F.col("free_b") / pb).alias("fe_b"))


def descriptor_at(points: DataFrame, voxel_features: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Descriptor of the voxel a row falls in; NULL where there is none."""
    return points.join(voxel_features, ["scan_id", "vx", "vy", "vz"], "left").join(
        descriptors, "feature_id", "left")


def merge_grids(a: DataFrame, b: DataFrame, keys: list[str], rule: Column) -> DataFrame:
    """Combine two grids: matching cells by ``rule`` (an aggregate), others kept."""
    return a.unionByName(b).groupBy(*keys).agg(rule)
