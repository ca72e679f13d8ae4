"""Placement operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, grids, placement
from ..plans import placing
from ..stages import cut
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check
from .grids import COMP_KEYED
from .scalars import DOOR_SQL, plan_doors_table

KEY = ["scan_id", "rot"]


def plan_of(v):
    """One plan: the darkest value of every cell over all grids."""
    return v.grid.where(F.col("value").isNotNull()).groupBy("row", "col").agg(F.max("value").alias("value"))


def templates_of(v, level: int = 3, side: int = 13):
    """Block means of every grid in four quarter turns."""
    p = grids.block_mean(v.grid, ["scan_id"], 2**level)
    r, c = F.col("row"), F.col("col")
    turns = F.array(*[F.struct(F.lit(k).alias("rot"), a.alias("row"), b.alias("col")) for k, (a, b) in enumerate(
        [(r, c), (side - 1 - c, r), (side - 1 - r, side - 1 - c), (c, side - 1 - r)])])
    return p.select("scan_id", "value", F.explode(turns).alias("t")).select("scan_id", "t.rot", "t.row", "t.col", "value")


PLAN = """pl AS (SELECT "row", col, max(value) AS value FROM v_grid WHERE value IS NOT NULL GROUP BY ALL),
 pw AS (SELECT scan_id, CAST("row" >> 3 AS INT) r, CAST(col >> 3 AS INT) c, avg(value) AS value FROM v_grid WHERE value <> 0 GROUP BY ALL),
 tp AS (SELECT scan_id, 0 rot, r, c, value FROM pw UNION ALL SELECT scan_id, 1, 12 - c, r, value FROM pw UNION ALL SELECT scan_id, 2, 12 - r, 12 - c, value FROM pw UNION ALL SELECT scan_id, 3, c, 12 - r, value FROM pw),
 tm AS (SELECT scan_id, rot, r, c, CASE WHEN value > 0.25 THEN value ELSE 0 END s, CASE WHEN value > 0.2 THEN value ELSE 0 END e FROM tp WHERE value > 0.05),
 mm AS (SELECT scan_id, rot, count(*) n_mask, sum(s) scan_mass FROM tm GROUP BY ALL),
 pc AS (SELECT "row", col, CASE WHEN value > 0.4 THEN value ELSE 0 END p, CASE WHEN value > 0.3 THEN value ELSE 0 END pe FROM pl),
 ex AS (SELECT scan_id, rot, max(r) + 1 AS rows, max(c) + 1 AS cols FROM tm GROUP BY ALL),
 cd AS (SELECT scan_id, rot, x, y FROM ex, LATERAL (SELECT unnest(generate_series(0, 100 - cols - 1)) AS x), LATERAL (SELECT unnest(generate_series(0, 100 - rows - 1)) AS y)),
 sm AS (SELECT scan_id, rot, x, y, count(*) n_inside, sum(p) plan_mass, sum(least(s, pe)) shared, sum(greatest(p - e, 0)) fp_scan
   FROM cd JOIN tm USING (scan_id, rot) JOIN pc ON pc."row" = r + y AND pc.col = c + x GROUP BY ALL),
 sc AS (SELECT scan_id, rot, x, y, n_inside, n_mask, plan_mass, scan_mass, scan_mass - shared AS scan_fp, fp_scan FROM sm JOIN mm USING (scan_id, rot))"""


def correlation(v):
    t = templates_of(v)
    tmpl = cut(placement.template(t.where("value > 0.25"), t.where("value > 0.2"), t.where("value > 0.05")), "template")
    p = plan_of(v)
    sheet = placement.sheet(p.where("value > 0.4"), p.where("value > 0.3"), p)
    size = tmpl.groupBy(*KEY).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    return placement.correlate(placement.initial_candidates(size, 100, 100), tmpl, sheet)


SUMS = ("plan_mass", "scan_mass", "scan_fp", "fp_scan")


@check("e01_e02_correlate", S(
    f"WITH {PLAN} SELECT scan_id, rot, CAST(x AS INT) AS x, CAST(y AS INT) AS y, n_inside, n_mask, " + ", ".join(f"{s4(c)} AS {c}" for c in SUMS) + " FROM sc", "v_grid"))
def _e01(v):
    return correlation(v).withColumns({c: r4(c) for c in SUMS})


SCORED = f"""{PLAN}, so AS (SELECT *, (1.5 * scan_fp / nullif(scan_mass, 0) + fp_scan / nullif(plan_mass, 0)) / 3.25 AS score FROM sc
   WHERE n_inside >= 0.7 * n_mask AND plan_mass >= 0.6 * scan_mass)"""


def scored(v):
    s = filters.gate_candidates(correlation(v)).withColumns({"door_uxp": F.lit(0.0), "door_count": F.lit(1.0)})
    return placement.score_candidates(s)


@check("e24_score_candidates", S(f"WITH {SCORED} SELECT scan_id, rot, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {s4('score')} AS score FROM so WHERE score IS NOT NULL", "v_grid"))
def _e24(v):
    return scored(v).select(*KEY, "x", "y", r4("score").alias("score"))


@check("d15_mass_under_mask", S(f"WITH {PLAN} SELECT scan_id, rot, n_mask, {s4('scan_mass')} AS scan_mass FROM mm", "v_grid"))
def _d15(v):
    t = templates_of(v)
    return placement.mass_under_mask(placement.template(t.where("value > 0.25"), t.where("value > 0.2"), t.where("value > 0.05"))).withColumn(
        "scan_mass", r4("scan_mass"))


@check("e03_door_agreement", S(
    f"""WITH {DOOR_SQL}, rs AS (SELECT "row", col, CASE WHEN max(value) > 0.9 THEN 2 ELSE 1 END AS value FROM v_grid WHERE value > 0.7 GROUP BY ALL),
    cd AS (SELECT DISTINCT scan_id, rot, x - 100 AS x, y - 70 AS y FROM v_place),
    px AS (SELECT c.scan_id, c.rot, x, y, door_id, k, round(cy + k * ay + y) AS r, round(cx + k * ax + x) AS c FROM cd c JOIN ds d ON d.scan_id = c.scan_id AND d.rot = c.rot, generate_series(0, 40) t(k) WHERE k < ceil(w)),
    u AS (SELECT DISTINCT r, c FROM px), nb AS (SELECT u.r, u.c, arg_min(value, (col - u.c) * 10 + ("row" - u.r)) AS hit FROM u JOIN rs ON rs."row" BETWEEN u.r - 2 AND u.r + 2 AND rs.col BETWEEN u.c - 2 AND u.c + 2 GROUP BY ALL),
    g AS (SELECT scan_id, rot, x, y, sum(hit) / 2.0 AS got FROM px JOIN nb USING (r, c) GROUP BY ALL), tt AS (SELECT scan_id, rot, sum(ceil(w)) AS total FROM ds GROUP BY ALL)
    SELECT scan_id, rot, x, y, coalesce(total, 0) - coalesce(got, 0) AS door_uxp, greatest(1.0, coalesce(total, 0)) AS door_count FROM cd LEFT JOIN tt USING (scan_id, rot) LEFT JOIN g USING (scan_id, rot, x, y)""",
    "v_doors", "v_place", "v_grid"))
def _e03(v):
    rs = v.grid.where("value > 0.7").groupBy("row", "col").agg(F.when(F.max("value") > 0.9, 2).otherwise(1).alias("value"))
    c = v.place.select(*KEY, (F.col("x") - 100).alias("x"), (F.col("y") - 70).alias("y")).distinct()
    return placement.door_agreement(c, plan_doors_table(v), rs)


MIN = """SELECT cand_id, scan_id, rot, x, y, score FROM v_place p WHERE NOT EXISTS (SELECT 1 FROM v_place q WHERE q.scan_id = p.scan_id AND q.rot = p.rot
   AND abs(q.x - p.x) <= 6 AND abs(q.y - p.y) <= 6 AND q.score < p.score)"""


@check("f03_local_minima", S(MIN, "v_place"))
def _f03(v):
    return placement.local_minima(v.place, KEY, F.lit(6)).select("cand_id", *KEY, "x", "y", "score")


@check("g05_adaptive_minima", S(
    f"""WITH m AS ({MIN}), st AS (SELECT scan_id, avg(score) - stddev_samp(score) * 1.2 AS base FROM v_place GROUP BY scan_id),
    n AS (SELECT scan_id, k, count(CASE WHEN score < base + k * 0.01::DOUBLE THEN 1 END) c FROM m JOIN st USING (scan_id), generate_series(0, 99) t(k) GROUP BY ALL),
    s AS (SELECT scan_id, coalesce(min(CASE WHEN c >= 30 THEN k END), 99) stop FROM n GROUP BY scan_id)
    SELECT cand_id, m.scan_id, rot, x, y, score FROM m JOIN st USING (scan_id) JOIN s USING (scan_id) WHERE score < base + stop * 0.01::DOUBLE""", "v_place"))
def _g05(v):
    return placement.adaptive_minima(v.place, ["scan_id"], KEY, F.lit(6), 1.2, want=30)


@check("h04_initial_candidates", S(
    "WITH s AS (SELECT scan_id, rot, CAST(count(*) % 20 AS INT) + 10 AS rows, CAST(max(x) % 20 AS INT) + 10 AS cols FROM v_place GROUP BY ALL) SELECT scan_id, rot, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM s, "
    "LATERAL (SELECT unnest(generate_series(0, 60 - cols - 1)) AS x), LATERAL (SELECT unnest(generate_series(0, 50 - rows - 1)) AS y)", "v_place"))
def _h04(v):
    s = v.place.groupBy(*KEY).agg((F.count("*") % 20 + 10).cast("int").alias("rows"), (F.max("x") % 20 + 10).cast("int").alias("cols"))
    return placement.initial_candidates(s, 50, 60)


RING = placement.ring()


@check("h05_refine_candidates", S(
    f"""WITH m AS (SELECT DISTINCT scan_id, rot, x, y FROM v_place),
    rg AS (SELECT unnest([{', '.join(f'[{i}, {j}]' for i, j in RING)}]) AS d, unnest(generate_series(0, 27)) AS n),
    a AS (SELECT scan_id, rot, 2 * x + i AS x, 2 * y + j AS y FROM m, generate_series(-2, 2) q(i), generate_series(-2, 2) w(j)),
    b AS (SELECT scan_id, rot, 2 * x + d[1] AS x, 2 * y + d[2] AS y FROM m, rg
      WHERE n % 2 = CASE WHEN substr(md5(scan_id || ':' || rot || ':' || x || ':' || y || ':' || (n // 2) || ':7'), 1, 1) < '8' THEN 0 ELSE 1 END)
    SELECT DISTINCT scan_id, rot, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""", "v_place"))
def _h05(v):
    return placement.refine_candidates(v.place)


@check("e19_dedupe_candidates", S("SELECT DISTINCT scan_id, rot, x, y FROM v_place", "v_place"))
def _e19(v):
    return placement.dedupe_candidates(v.place).select(*KEY, "x", "y")


def _small_scans(v):
    """Brightened block means as scans (25 x 25) with their masks."""
    t = templates_of(v, 2, 25)
    return t.withColumn("value", F.least(F.col("value") * 2, F.lit(1.0))), t.select(*KEY, "row", "col", F.lit(1.0).alias("value"))


@check("k01_plan_front", S(
    f"""WITH {COMP_KEYED}, sz AS (SELECT scan_id, comp, count(*) n FROM lb GROUP BY ALL), mn AS (SELECT scan_id, avg(n) m FROM sz GROUP BY scan_id),
    kp AS (SELECT scan_id, CAST(id >> 31 AS INT) AS r, CAST(id % 2147483648 AS INT) AS c FROM lb JOIN sz USING (scan_id, comp) JOIN mn USING (scan_id) WHERE n >= m)
    SELECT scan_id, r + 5 AS "row", c + 5 AS col, {s4("1 - (255 - trunc(value * 255)) / 255.0")} AS value FROM kp JOIN v_grid g USING (scan_id) WHERE g."row" = r AND g.col = c""", "v_grid", recursive=True))
def _k01f(v):
    """Every grid as a plan image of its own."""
    dark = F.when(F.col("value") > 0.4, 255 - F.floor(F.col("value") * 255)).otherwise(255)
    plan, rows, cols = placing.plan_front(v.grid.select("scan_id", "row", "col", dark.cast("int").alias("grey")), 100, 100)
    assert (rows, cols) == (110, 110)
    return plan.withColumn("value", r4("value"))


@check("k01_place_scans")
def _k01(v):
    s, m = _small_scans(v)
    return placing.place_scans(plan_of(v), (100, 100), s, m, (25, 25), levels=2).select(*KEY, "x", "y", "score")


@check("e17_plan_doors")
def _e17(v):
    sym = v.grid.groupBy((F.col("row") % 16).alias("row"), (F.col("col") % 16).alias("col")).agg(F.avg("value").alias("value"))
    sym = sym.where("value > 0.25")
    return placing.plan_doors(plan_of(v).where("value > 0.4"), (100, 100), sym, (16, 16))


@check("k03_find_scale")
def _k03f(v):
    """Scale at which the scan points fit a plan drawn from them at 10.3 cells per unit."""
    def cells(scale, *key):
        at = lambda c: F.floor((F.col(c) + 2) * scale).cast("int")
        return v.scanpts.select(*key, at("y").alias("row"), at("x").alias("col"), F.lit(1.0).alias("value")).distinct()

    plan = cells(F.lit(10.3)).withColumns({"row": F.col("row") + 6, "col": F.col("col") + 9})
    sheet = cut(placement.sheet(plan, plan, plan), "sheet")

    def score_at(scales):
        at = F.array(*[F.struct(F.lit(k).alias("rot"), F.lit(float(s)).alias("scale")) for k, s in enumerate(scales)])
        t = v.scanpts.select("x", "y", F.explode(at).alias("t")).select(
            F.lit(0).alias("scan_id"), "t.rot", "t.scale", F.floor((F.col("y") + 2) * F.col("t.scale")).cast("int").alias("row"),
            F.floor((F.col("x") + 2) * F.col("t.scale")).cast("int").alias("col")).distinct().withColumn("value", F.lit(1.0))
        tmpl = cut(placement.template(t, t, t), "template")
        size = tmpl.groupBy(*KEY).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
        sums = placement.correlate(placement.initial_candidates(size, 64, 64), tmpl, sheet)
        s = placement.score_candidates(sums.withColumns({"door_uxp": F.lit(0.0), "door_count": F.lit(1.0)}))
        return s.join(t.select("rot", "scale").distinct(), "rot").select("scale", "score")

    return v.spark.range(1).select(F.lit(placing.find_scale(score_at, 10.0)).alias("scale"))


@check("k03_scale_scores", S(
    """WITH g AS (SELECT s AS scale, floor(x * s) AS c, floor(y * s) AS r, count(*) n FROM v_points, (VALUES (4.0), (5.0), (6.0)) t(s) GROUP BY ALL)
    SELECT CAST(scale AS DOUBLE) AS scale, count(*) AS cells, """ + s4("avg(n)") + " AS mean FROM g GROUP BY scale", "v_points"))
def _k03(v):
    p = v.points.select("x", "y").withColumn("scale", F.explode(F.array(*[F.lit(s) for s in (4.0, 5.0, 6.0)])))
    g = p.groupBy("scale", F.floor(F.col("x") * F.col("scale")).alias("c"), F.floor(F.col("y") * F.col("scale")).alias("r")).agg(F.count("*").alias("n"))
    return g.groupBy("scale").agg(F.count("*").alias("cells"), r4(F.avg("n")).alias("mean"))
