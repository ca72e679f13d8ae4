"""Filters (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import weights as Wt
from ..operators import filters, graph, stats
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check

VALID = "SELECT * FROM v_points WHERE NOT (x = 0 AND y = 0 AND z = 0) AND intensity >= 0.01"
PT = "scan_id, x, y, z, intensity, r, g, b"


def box_sql(src: str, ranges=(9.0, 9.0, 6.0), name: str = "bx") -> str:
    """CTEs ``<name>_s`` (means, deviations) and ``<name>`` (limits) over ``src``."""
    st = ", ".join(f"avg({a}) AS m{a}, stddev_samp({a}) AS s{a}" for a in "xyz")
    lim = ", ".join(f"m{a} - s{a} * {k} * 1.1 / 2.0 AS {a}0, m{a} + s{a} * {k} * 1.1 / 2.0 AS {a}1" for a, k in zip("xyz", ranges))
    return f"{name}_s AS (SELECT scan_id, {st} FROM {src} GROUP BY scan_id), {name} AS (SELECT scan_id, {lim} FROM {name}_s)"


@check("b01_valid_returns", S(VALID, "v_points"))
def _b01(v):
    return filters.valid_returns(v.points)


@check("b02_in_box_intensity", S(
    f"WITH {box_sql('v_points', (1.5, 1.5, 1.5))} SELECT {', '.join('p.' + c for c in PT.split(', '))} FROM v_points p JOIN bx USING (scan_id) "
    "WHERE p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1 AND p.z BETWEEN z0 AND z1 AND intensity >= 0.01", "v_points"))
def _b02(v):
    box = filters.sigma_box(stats.box_stats(v.points, ["scan_id"]), (1.5, 1.5, 1.5))
    return filters.in_box(v.points, box, ["scan_id"], 0.01)


@check("b03_sigma_box", S(
    f"WITH {box_sql('v_points', (10.0, 10.0, 6.0))} SELECT scan_id, " + ", ".join(f"{s4(c)} AS {c}" for c in ("x0", "x1", "y0", "y1", "z0", "z1"))
    + " FROM bx", "v_points"))
def _b03(v):
    box = filters.sigma_box(stats.box_stats(v.points, ["scan_id"]), (10.0, 10.0, 6.0))
    return box.select("scan_id", *[r4(c).alias(c) for c in ("x0", "x1", "y0", "y1", "z0", "z1")])


@check("b04_outside_radius", S("SELECT * FROM v_points WHERE x * x + y * y > 1", "v_points"))
def _b04(v):
    return filters.outside_radius(v.points)


BROKEN = "SELECT idx, scan_id, CASE WHEN idx % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE nx END AS nx, ny, CASE WHEN idx % 11 = 0 THEN NULL ELSE nz END AS nz FROM v_normals"


@check("b05_finite_normals", S(
    f"WITH k AS ({BROKEN}) SELECT idx, scan_id, {s4('nx')} AS nx, {s4('ny')} AS ny, {s4('nz')} AS nz FROM k WHERE NOT isnan(nx) AND nz IS NOT NULL", "v_normals"))
def _b05(v):
    k = v.normals.withColumn("nx", F.when(F.col("idx") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("nx"))).withColumn(
        "nz", F.when(F.col("idx") % 11 != 0, F.col("nz")))
    return filters.finite_normals(k).select("idx", "scan_id", *[r4(c).alias(c) for c in ("nx", "ny", "nz")])


@check("b06_perpendicular", S(
    "SELECT idx, scan_id FROM v_normals WHERE asin(least(sqrt(nx * nx + ny * ny), 1.0)) > pi() / 2 - 0.02", "v_normals"))
def _b06(v):
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return filters.perpendicular_to(v.normals, up).select("idx", "scan_id")


@check("b07_confident", S('SELECT scan_id, "row", col, value FROM v_grid WHERE value > 0.75', "v_grid"))
def _b07(v):
    return filters.confident(v.grid, 0.75)


@check("b08_valid_keypoints", S(
    """WITH pc AS (SELECT scan_id, "row", col, coalesce(value, 0) AS depth, CASE WHEN col % 5 = 0 THEN 0.0 ELSE 1.0 END AS nx FROM v_grid),
    kp AS (SELECT event_id AS kp_id, CAST(floor(event_id / 10000) AS INT) AS scan_id, (event_id * 7) % 100 + 0.5 AS x,
           (event_id * 3) % 100 + 0.25 AS y FROM events)
    SELECT kp_id, kp.scan_id, x, y FROM kp WHERE EXISTS (SELECT 1 FROM pc WHERE pc.scan_id = kp.scan_id AND pc."row" = trunc(kp.y)
           AND pc.col = trunc(kp.x) AND pc.depth <> 0 AND pc.nx <> 0)""", "v_grid"))
def _b08(v):
    pano = v.grid.select("scan_id", "row", "col", F.coalesce("value", F.lit(0.0)).alias("depth"),
                         F.when(F.col("col") % 5 == 0, 0.0).otherwise(1.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz"))
    e = F.col("event_id")
    kp = v.table("events").select(e.alias("kp_id"), F.floor(e / 10000).cast("int").alias("scan_id"),
                                  (e * 7 % 100 + 0.5).alias("x"), (e * 3 % 100 + 0.25).alias("y"))
    return filters.valid_keypoints(kp, pano)


@check("b09_scored", S(
    "SELECT cand_id, score FROM (SELECT cand_id, CASE WHEN cand_id % 5 = 0 THEN -1 WHEN cand_id % 7 = 0 THEN NULL ELSE score END AS score "
    "FROM v_place) WHERE score IS NOT NULL AND score <> -1", "v_place"))
def _b09(v):
    s = F.when(F.col("cand_id") % 5 == 0, -1.0).when(F.col("cand_id") % 7 == 0, None).otherwise(F.col("score"))
    return filters.scored(v.place.withColumn("score", s)).select("cand_id", "score")


@check("b10_drop_outliers", S(
    f"WITH s AS (SELECT scan_id, avg(h) m, stddev_samp(h) sd FROM v_doors GROUP BY scan_id) SELECT door_id, d.scan_id, {s4('h')} AS h, {s4('w')} AS w "
    "FROM v_doors d JOIN s USING (scan_id) WHERE abs(h - m) / sd <= 1", "v_doors"))
def _b10(v):
    return filters.drop_outliers(v.doors, "h", ["scan_id"]).select("door_id", "scan_id", r4("h").alias("h"), r4("w").alias("w"))


@check("b12_gate_candidates", S(
    "WITH c AS (SELECT cand_id, x AS n_inside, 150 AS n_mask, y / 10.0 AS plan_mass, score * 20 AS scan_mass FROM v_place) "
    "SELECT cand_id FROM c WHERE n_inside >= 0.7 * n_mask AND plan_mass >= 0.6 * scan_mass", "v_place"))
def _b12(v):
    c = v.place.select("cand_id", F.col("x").alias("n_inside"), F.lit(150).alias("n_mask"), (F.col("y") / 10.0).alias("plan_mass"),
                       (F.col("score") * 20).alias("scan_mass"))
    return filters.gate_candidates(c).select("cand_id")


@check("b13_clip", S("SELECT * FROM v_points WHERE x >= -2 AND x < 3 AND z >= 0 AND z < 1", "v_points"))
def _b13(v):
    return filters.clip(v.points, {"x": (-2, 3), "z": (0, 1)})


@check("b15_keep_edges", S(
    "SELECT cand_id, score - 0.3 AS w, x / 200.0 AS w_sig FROM v_place WHERE x / 200.0 >= 0.05 AND abs(score - 0.3) >= 0.05", "v_place"))
def _b15(v):
    e = v.place.select("cand_id", (F.col("score") - 0.3).alias("w"), (F.col("x") / 200.0).alias("w_sig"))
    return filters.keep_edges(e)


@check("b16_small_motion", S(
    """WITH m AS (SELECT cand_id, score / 4 AS a, (x - 100) / 400.0 AS tx, (y - 75) / 400.0 AS ty FROM v_place)
    SELECT cand_id, abs(tx) < 0.2 AND abs(ty) < 0.2 AND acos(abs(cos(a))) < 0.05 AS ok FROM m""", "v_place"))
def _b16(v):
    a = F.col("score") / 4
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.array(F.cos(a), -F.sin(a), zero, (F.col("x") - 100) / 400.0, F.sin(a), F.cos(a), zero, (F.col("y") - 75) / 400.0,
                zero, zero, one, zero, zero, zero, zero, one)
    return v.place.select("cand_id", G.is_small_motion(m).alias("ok"))


@check("b17_accept_below", S(
    "SELECT cand_id, score FROM v_place WHERE score < (SELECT avg(score) - 1.2 * stddev_samp(score) FROM v_place)", "v_place"))
def _b17(v):
    return filters.accept_below(v.place).select("cand_id", "score")


@check("b18_not_white", S("SELECT scan_id, x, y, z, r, g, b FROM v_points WHERE NOT (r > 240 AND g > 240 AND b > 240)", "v_points"))
def _b18(v):
    return filters.not_white(v.points, ["r", "g", "b"]).select("scan_id", "x", "y", "z", "r", "g", "b")


@check("c14_edge_weight", S(
    f"SELECT cand_id, {s4('(score * 0.8 * 0.5 + (x / 200.0) * 0.6) * greatest(0.25, least(1.5, y / 75.0)) - 0.1')} AS weight FROM v_place", "v_place"))
def _c14(v):
    w = Wt.edge_weight(F.col("score"), F.lit(0.8), F.col("x") / 200.0, F.lit(0.6), F.col("y") / 75.0, F.lit(-0.1))
    return v.place.select("cand_id", r4(w).alias("weight"))
