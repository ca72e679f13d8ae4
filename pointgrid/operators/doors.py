"""Finding doorways in a cloud by walking along voxel depths.

All probes of a step are expanded, looked up by equi-join in the voxel table and
reduced to the first step that ends the walk; no cell is visited in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..stages import cut, grown, measured, spread

# Fixed values of the door search.
VPM = 50.0
GRADIENT = 2.0
WIDTH_MIN, WIDTH_MAX = 0.4, 2.5
HEIGHT_MAX, HEIGHT_MIN = (2.1, 2.6, 0.9), (1.8, 0.5)
NOTHING = 1e10
CANDIDATE = ["scan_id", "ci", "cj", "axis"]


def first_failing(df: DataFrame, by: list[str], step: str, cond: Column, name: str = "first") -> DataFrame:
    """First step of each walk on which ``cond`` holds; NULL when it never does."""
    return df.groupBy(*by).agg(F.min(F.when(cond, F.col(step))).alias(name))


def door_limits(spans: DataFrame, vpm: float = VPM) -> DataFrame:
    """Smallest and largest door height in voxels from the storey height ``dz``."""
    low, high, share = HEIGHT_MAX
    return spans.select(
        "scan_id", "floor_coord",
        (F.greatest(F.lit(low), F.least(F.lit(high), F.col("dz") * share)) * vpm).alias("h_max"),
        (F.least(F.lit(HEIGHT_MIN[0]), F.col("dz") * HEIGHT_MIN[1]) * vpm).alias("h_min"))


def _away(c: Column) -> Column:
    return (F.signum(c) * F.floor(F.abs(c) + 0.5)).cast("int")


def depth_at(probes: DataFrame, voxels: DataFrame, keys: list[str], depth_reach: float, side_reach: float,
             vpm: float = VPM) -> DataFrame:
    """Depth found first near each probe point, searching outward.

    A probe ``keys, scan_id, px, py, pz, ax, ay, az`` looks along the direction at right
    angles to its axis (on the far side of the scanner), then along the axis; within half
    the reach it also looks backward. Returns ``keys`` with ``found`` or 1e10.
    """
    i_last, j_last = int(depth_reach * vpm + 1e-9), int(side_reach * vpm + 1e-9)
    order, moves = 0, []
    for i in range(i_last + 1):
        for j in range(j_last + 1):
            moves.append((order, i, j))
            order += 1
            if i <= depth_reach * vpm / 2.0 and j <= side_reach * vpm / 2.0:
                moves.append((order, -i, -j))
                order += 1
    flip = F.when(F.col("ay") * F.col("px") - F.col("ax") * F.col("py") + F.col("az") * F.col("pz") < 0, -1.0).otherwise(1.0)
    p = probes.select("*", (F.col("ay") * flip).alias("dx"), (-F.col("ax") * flip).alias("dy"), (F.col("az") * flip).alias("dz"))
    table = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(i).alias("i"), F.lit(j).alias("j")) for o, i, j in moves])
    p = p.withColumn("_m", F.explode(table))
    at = [_away(F.col(f"p{a}") + F.col("_m.i") * F.col(f"d{a}") + F.col("_m.j") * F.col(f"a{a}")).alias(f"v{a}") for a in "xyz"]
    hit = grown(p.select("scan_id", *[k for k in keys if k != "scan_id"], F.col("_m.o").alias("o"), *at)).join(
        voxels, ["scan_id", "vx", "vy", "vz"])
    best = hit.groupBy(*keys).agg(F.min_by("depth", "o").alias("found"))
    return probes.select(*keys).join(best, keys, "left").select(*keys, F.coalesce("found", F.lit(NOTHING)).alias("found"))


def line_depths(probes: DataFrame, voxels: DataFrame, axes: DataFrame, keys: list[str], depth_reach: float, vpm: float = VPM) -> DataFrame:
    """As ``depth_at`` without side reach, for probes on the grid of the scan's own axes.

    A probe ``keys, scan_id, axis, ci, cj, along, up, floor`` lies at ``second * ci + third * cj``
    plus ``along`` its axis and ``up``. It looks along the other axis, so all probes with the same
    offset and height look along one line, at whole steps. Each line is looked up in the voxels once,
    and every probe takes the hit before or behind it that its search reaches first. Only for axes at
    right angles in the plane (``on_lines``).
    """
    reach, back = int(depth_reach * vpm + 1e-9), int(depth_reach * vpm / 2.0)
    odd = F.col("axis") % 2 == 1
    sign = F.when(F.col("axis") < 2, 1.0).otherwise(-1.0)
    p = probes.join(axes, "scan_id").select(
        *keys, *[c for c in ("scan_id",) if c not in keys], "second", "third", F.col("up_axis").alias("_ua"), "floor", odd.alias("_odd"), F.col("up").alias("_up"),
        (F.when(odd, F.col("cj")).otherwise(F.col("ci")) + F.col("along") * sign).alias("_u"),
        F.when(odd, F.col("ci")).otherwise(F.col("cj")).cast("long").alias("_t"), sign.alias("_sign"))
    line = ["scan_id", "_odd", "_u", "_up"]
    fixed, moving = F.when(F.col("_odd"), F.col("third")).otherwise(F.col("second")), F.when(F.col("_odd"), F.col("second")).otherwise(F.col("third"))

    def at(i: int) -> Column:
        return fixed[i] * F.col("_u") + moving[i] * F.col("_t") + F.col("_ua")[i] * F.col("_up") + (F.col("floor") if i == 2 else 0)

    ends = p.groupBy(*line).agg(F.min("_t").alias("_a"), F.max("_t").alias("_z"), *[F.first(c).alias(c) for c in ("second", "third", "_ua", "floor")])
    spots = ends.withColumn("_t", F.explode(F.sequence(F.col("_a") - reach, F.col("_z") + reach)))
    spots = spots.select(*line, "_t", *[_away(at(i)).alias(f"v{a}") for i, a in enumerate("xyz")])
    hits = grown(spots).join(voxels, ["scan_id", "vx", "vy", "vz"]).select(*line, "_t", F.struct("_t", "depth").alias("_hit"))
    # The side away from the scanner, as a step along the line.
    a = [fixed[i] * F.col("_sign") for i in range(3)]
    flip = F.when(a[1] * at(0) - a[0] * at(1) + a[2] * at(2) < 0, -1.0).otherwise(1.0)
    ahead = F.signum((a[1] * moving[0] - a[0] * moving[1]) * flip)
    steps = p.select(*line, "_t", F.struct(*[k for k in keys]).alias("_key"), ahead.alias("_ahead"))
    every = steps.unionByName(hits, allowMissingColumns=True)
    upto = lambda order: F.last("_hit", ignorenulls=True).over(W.partitionBy(*line).orderBy(order).rangeBetween(W.unboundedPreceding, 0))
    every = every.withColumn("_low", upto(F.col("_t"))).withColumn("_high", upto(F.col("_t").desc())).where("_key IS NOT NULL")
    near = lambda side, other: F.when(F.col("_ahead") > 0, F.col(side)).otherwise(F.col(other))
    every = every.withColumn("_f", near("_high", "_low")).withColumn("_b", near("_low", "_high"))
    f, b = F.abs(F.col("_f._t") - F.col("_t")), F.abs(F.col("_b._t") - F.col("_t"))
    forward = (f <= reach) & (b.isNull() | (b > back) | (f <= b))
    found = F.when(forward, F.col("_f.depth")).when(b <= back, F.col("_b.depth")).otherwise(F.lit(NOTHING))
    return every.select("_key.*", found.alias("found"))


def on_lines(second: Column, third: Column) -> Column:
    """Whether two axes lie in the plane at right angles, so that searches along them stay on whole steps."""
    flat = F.greatest(F.abs(second[2]), F.abs(third[2])) < 1e-12
    return flat & (F.abs(F.abs(second[0] * third[1] - second[1] * third[0]) - 1) < 1e-12) & (F.abs(second[0] * third[0] + second[1] * third[1]) < 1e-12)


def _probe(cands: DataFrame, along: Column, up: Column) -> DataFrame:
    """Probe points ``along`` the candidate's axis and ``up`` from its floor cell."""
    return cands.select("*", *[
        (F.col(f"c{a}") + F.col(f"a{a}") * along + F.col(f"u{a}") * up).alias(f"p{a}") for a in "xyz"])


def _gap(walk: DataFrame, voxels: DataFrame, keys: list[str], one: tuple[Column, Column], two: tuple[Column, Column],
         reach: tuple[float, float], vpm: float) -> DataFrame:
    """Adds the depth difference between two probe points of every step."""
    both = _probe(walk, *one).withColumn("side", F.lit(0)).unionByName(_probe(walk, *two).withColumn("side", F.lit(1)))
    d = depth_at(both.select(*keys, "side", *[f"p{a}" for a in "xyz"], *[f"a{a}" for a in "xyz"]),
                 voxels, keys + ["side"], *reach, vpm)
    gap = d.groupBy(*keys).agg(F.abs(F.max(F.when(F.col("side") == 0, F.col("found"))) - F.max(
        F.when(F.col("side") == 1, F.col("found")))).alias("gap"))
    return grown(walk).join(gap, keys)


def find_doors(voxels: DataFrame, axes: DataFrame, limits: DataFrame, vpm: float = VPM) -> DataFrame:
    """Doorways of every scan: ``scan_id, ci, cj, axis, h, w`` (metres) and the corner.

    ``voxels`` is ``(scan_id, vx, vy, vz, depth)``, ``axes`` the up, second and third
    direction as ``up, second, third`` (arrays), ``limits`` from ``door_limits``. Each
    stage narrows the candidates before the next expands its steps: height of the
    lintel, width at several heights, the jump along the top edge, a second walk close
    to the jamb. Runs jobs.
    """
    ext = voxels.groupBy("scan_id").agg(*[f(f"v{a}").alias(f"{n}{a}") for a in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    base = ext.join(axes, "scan_id").join(limits, "scan_id").where("hix > lox AND hiy > loy")
    base = base.withColumn("ci", F.explode(F.sequence("lox", F.col("hix") - 1))).withColumn(
        "cj", F.explode(F.sequence("loy", F.col("hiy") - 1)))
    base = spread(base, "scan_id", "ci", "cj")
    base = base.withColumn("axis", F.explode(F.sequence(F.lit(0), F.lit(3))))
    sign = F.when(F.col("axis") < 2, 1.0).otherwise(-1.0)
    pick = lambda i: F.when(F.col("axis") % 2 == 0, F.col("second")[i]).otherwise(F.col("third")[i]) * sign
    floor = G.trunc(F.col("floor_coord") * vpm)
    base = base.select(
        *CANDIDATE, "h_min", "h_max", on_lines(F.col("second"), F.col("third")).alias("lines"), floor.alias("floor"), *[pick(i).alias(f"a{a}") for i, a in enumerate("xyz")],
        *[F.col("up")[i].alias(f"u{a}") for i, a in enumerate("xyz")],
        *[(F.col("second")[i] * F.col("ci") + F.col("third")[i] * F.col("cj") + (floor if a == "z" else 0)).alias(f"c{a}")
          for i, a in enumerate("xyz")])

    # Height of the lintel. Steps start above 0.2 m and end shortly above the limit. A walk
    # that ends below the smallest height is no door, so a few early steps are tried first
    # and only their survivors, next to an opening, expand the whole walk.
    start = int(0.2 * vpm)
    keys = CANDIDATE + ["k"]
    k = F.col("k").cast("double")
    side = F.lit(0.15 * vpm)

    lines = measured(axes.select("scan_id", "second", "third", F.col("up").alias("up_axis")))

    def climb(cands: DataFrame, low: int, high: Column) -> DataFrame:
        walk = cands.where(high >= low).withColumn("k", F.explode(F.sequence(F.lit(low), high)))
        both = [walk.where("lines").select(*keys, "floor", k.alias("up"), (side * s).alias("along"), F.lit(i).alias("side")) for i, s in enumerate((1, -1))]
        d = line_depths(both[0].unionByName(both[1]), voxels, lines, keys + ["side"], 0.8, vpm)
        each = lambda i: F.max(F.when(F.col("side") == i, F.col("found")))
        gap = d.groupBy(*keys).agg(F.abs(each(0) - each(1)).alias("gap"))
        other = _gap(walk.where("NOT lines"), voxels, keys, (side, k), (-side, k), (0.8, 0.0), vpm)
        return grown(walk).join(gap, keys).unionByName(other)

    for steps in (1, 4):
        early = F.least(F.lit(start + steps), F.ceil("h_min").cast("int") - 1)
        ended = climb(base, start + 1, early).where(~(F.col("gap") > GRADIENT)).select(*CANDIDATE).distinct()
        base = cut(base.join(grown(ended), CANDIDATE, "left_anti"), "doors")
    walk = climb(base, start + 1, F.floor("h_max").cast("int") + 11)
    height = first_failing(walk, CANDIDATE, "k", ~(F.col("gap") > GRADIENT) | ~(F.col("k") <= F.col("h_max") + 10), "h")
    found = grown(base).join(height, CANDIDATE).where((F.col("h") >= F.col("h_min")) & (F.col("h") <= F.col("h_max")))
    found = cut(found, "doors")

    # Width at heights h/2, h/2 + h/20, ... 18h/20.
    wide = found.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn(
        "ch", F.col("h") / 2.0 + F.col("q") * F.col("h") / 20.0)
    w_max, w_min = WIDTH_MAX * vpm, WIDTH_MIN * vpm
    wide = wide.withColumn("s", F.explode(F.sequence(F.lit(6), F.lit(int(w_max) + 1))))
    keys = CANDIDATE + ["q", "s"]
    probe = _probe(wide, F.col("s").cast("double"), F.col("ch"))
    d = depth_at(probe.select(*keys, *[f"p{a}" for a in "xyz"], *[f"a{a}" for a in "xyz"]), voxels, keys, 0.8, 0.0, vpm)
    stop = first_failing(d, CANDIDATE + ["q"], "s", ~((F.col("found") > 1e9) & (F.col("s") <= w_max)), "w")
    widths = stop.groupBy(*CANDIDATE).agg(F.min("w").alias("w_low"), F.max("w").alias("w_high"))
    found = found.join(widths, CANDIDATE).where(
        (F.col("w_low") >= w_min) & (F.col("w_high") + 1 < w_max) & (F.col("w_high") - F.col("w_low") <= 0.1 * vpm))
    found = cut(found.withColumn("w", (F.col("w_high") + F.col("w_low")) / 2.0), "doors")

    # The depth jumps along most of the top edge.
    edge = found.withColumn("e", F.explode(F.sequence(F.lit(0), F.ceil("w").cast("int") - 1)))
    keys = CANDIDATE + ["e"]
    e = F.col("e").cast("double")
    edge = _gap(edge, voxels, keys, (e, F.col("h") + 0.1 * vpm), (e, F.col("h") - 0.1 * vpm), (0.3, 0.1), vpm)
    on = edge.groupBy(*CANDIDATE).agg(F.sum((F.col("gap") > GRADIENT).cast("int")).alias("on_edge"))
    found = cut(found.join(on, CANDIDATE).where(F.col("on_edge") >= F.col("w") * 0.8), "doors")

    # A second walk close to the jamb ends at about the same height.
    again = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("h_max") - F.col("h") / 2.0).cast("int") + 2)))
    keys = CANDIDATE + ["k"]
    up = F.col("h") / 2.0 + F.col("k")
    near = F.lit(0.05 * vpm)
    again = _gap(again, voxels, keys, (near, up), (-near, up), (0.1, 0.0), vpm).withColumn("h2", up)
    second = first_failing(again, CANDIDATE, "h2", ~(F.col("gap") > GRADIENT) | ~(F.col("h2") <= F.col("h_max")), "h2")
    found = found.join(second, CANDIDATE).where(F.abs(F.col("h2") - F.col("h")) <= 0.1 * vpm)
    return found.select(
        *CANDIDATE, F.struct(*[(F.col(f"c{a}") / vpm).alias(a) for a in "xyz"]).alias("corner"),
        F.struct(*[F.col(f"a{a}").alias(a) for a in "xyz"]).alias("x_axis"),
        F.struct(*[F.col(f"u{a}").alias(a) for a in "xyz"]).alias("z_axis"),
        (F.col("h") / vpm).alias("h"), (F.col("w") / vpm).alias("w"))


def rotate_doors(doors: DataFrame, rotations: DataFrame) -> DataFrame:
    """Doors in each rotation's frame: handedness flipped, then turned back."""
    d = doors.drop("rot").join(rotations, "scan_id")

    def turn(c: str) -> Column:
        v = G.rotate_inv(G.flip_y(tuple(F.col(f"{c}.{a}") for a in "xyz")), F.col("m"))
        return F.struct(*[x.alias(a) for x, a in zip(v, "xyz")]).alias(c)

    keep = [c for c in d.columns if c not in ("m", "corner", "x_axis", "z_axis")]
    return d.select(*keep, *[turn(c) for c in ("corner", "x_axis", "z_axis")])
