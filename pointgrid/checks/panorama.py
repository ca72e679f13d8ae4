"""Panorama comparison."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import panorama
from ..stages import cut
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check


def pano_of(v):
    """Every grid as a nearly flat panorama with one normal."""
    g = v.grid.where(F.col("value").isNotNull())
    return g.select("scan_id", "row", "col", (F.col("value") * 200).alias("r"), (F.col("value") * 100 + F.col("col")).alias("g"),
                    (F.col("row") + F.col("value") * 50).alias("b"), (F.lit(2.0) + F.col("value") * 0.3).alias("depth"),
                    F.lit(0.6).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.8).alias("nz"))


def keypoints_of(v):
    e = F.col("event_id")
    return v.table("events").select(F.floor(e / 10000).cast("int").alias("scan_id"), e.alias("kp_id"),
                                    (e * 7 % 100 + 0.5).alias("x"), (e * 3 % 100 + 0.25).alias("y"))


T = (0.05, -0.03, 0.02)
TURN = 0.1


def pairs_of(v):
    """Every scan against itself, turned and moved a little."""
    c, s = math.cos(TURN), math.sin(TURN)
    eye = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    rot = F.array(*[F.lit(x) for x in (c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0)])
    return v.grid.select("scan_id").distinct().select(
        F.col("scan_id").alias("pair"), F.col("scan_id").alias("src"), F.col("scan_id").alias("dst"),
        eye.alias("r_src"), rot.alias("r_dst"), F.array(*[F.lit(x) for x in T]).alias("t"))


C, SN = f"cos({TURN}::DOUBLE)", f"sin({TURN}::DOUBLE)"
MATCH = f"""pc AS (SELECT scan_id, "row", col, 2.0::DOUBLE + value * 0.3::DOUBLE AS depth, value FROM v_grid WHERE value IS NOT NULL),
 pa AS (SELECT a.*, (SELECT 1) AS one, x.ave FROM pc a JOIN (SELECT a.scan_id, a."row", a.col, avg(b.depth) ave FROM pc a JOIN pc b ON b.scan_id = a.scan_id AND b."row" BETWEEN a."row" - 5 AND a."row" + 5 AND b.col BETWEEN a.col - 5 AND a.col + 5 GROUP BY ALL) x USING (scan_id, "row", col)),
 kp AS (SELECT CAST(floor(event_id / 10000) AS INT) AS scan_id, event_id AS kp_id, event_id * 7 % 100 + 0.5 AS x, event_id * 3 % 100 + 0.25 AS y FROM events),
 k1 AS (SELECT kp.*, depth AS r, ave FROM kp JOIN pa ON pa.scan_id = kp.scan_id AND pa."row" = trunc(y) AND pa.col = trunc(x) WHERE depth >= 0.5),
 k2 AS (SELECT *, (2 * x / 99.0 + 1) * pi() AS th, y * 2.61946 / 99.0 AS ph FROM k1),
 k3 AS (SELECT *, r * cos(th) * sin(ph) AS vx, -(r * sin(th) * sin(ph)) AS vy, r * cos(ph) AS vz FROM k2),
 k4 AS (SELECT *, {C} * vx - {SN} * vy AS wx, {SN} * vx + {C} * vy AS wy, vz AS wz, {C} * {T[0]} - {SN} * ({T[1]}) AS sx, {SN} * {T[0]} + {C} * ({T[1]}) AS sy FROM k3),
 k5 AS (SELECT *, wx + sx AS ux, wy + sy AS uy, wz + {T[2]} AS uz FROM k4),
 k6 AS (SELECT *, sqrt(ux*ux + uy*uy + uz*uz) AS radius, (atan2(-uy, ux) / pi() + 1) * 99.0 / 2 AS bx, acos(uz / sqrt(ux*ux + uy*uy + uz*uz)) * 99.0 / 2.61946 AS by_ FROM k5),
 k7 AS (SELECT k6.*, pa.depth AS true_r, pa.ave AS ave_b FROM k6 JOIN pa ON pa.scan_id = k6.scan_id AND pa."row" = trunc(by_) AND pa.col = trunc(bx) WHERE bx >= 0 AND bx < 100 AND by_ >= 0 AND by_ < 100),
 mt AS (SELECT * FROM k7 WHERE acos(greatest(least((wx*ux + wy*uy + wz*uz) / (sqrt(wx*wx+wy*wy+wz*wz) * radius), 1.0), -1.0)) <= 20 * pi() / 180 AND abs(radius - true_r) <= 0.3
   AND abs(ave - r) <= 0.3 AND abs(true_r - ave_b) <= 0.3 AND acos(0.6 * 0.6 * {C} + 0.64) <= 20 * pi() / 180)"""


def matches_of(v):
    return panorama.reproject(keypoints_of(v), panorama.with_local_depth(pano_of(v)), pairs_of(v), 100, 100)


@check("e12_b14_reproject", S(
    f"""WITH {MATCH} SELECT scan_id AS pair, kp_id, {s4('bx')} AS bx, {s4('by_')} AS "by", {s4('radius')} AS radius, {s4('true_r')} AS true_r,
    CAST(greatest(0, round(ln(radius / r) / (ln(2) / 3))) AS INT) AS src_level, CAST(greatest(0, round(ln(r / radius) / (ln(2) / 3))) AS INT) AS dst_level FROM mt""", "v_grid"))
def _e12(v):
    m = matches_of(v)
    return m.select("pair", "kp_id", *[r4(c).alias(c) for c in ("bx", "by", "radius", "true_r")], "src_level", "dst_level")


LEVEL = f"""s AS (SELECT pow(2.0, 2.0 / 3.0) AS s), e AS (SELECT scan_id, "row" AS r, col AS c, value * 200 AS v, s FROM v_grid, s WHERE value IS NOT NULL),
 f AS (SELECT scan_id, r, c, v, s, tr, tc, least((r + 1) / s, tr + 1) - greatest(r / s, tr) AS wr, least((c + 1) / s, tc + 1) - greatest(c / s, tc) AS wc FROM e,
   LATERAL (SELECT unnest(generate_series(CAST(floor(r / s) AS INT), CAST(ceil((r + 1) / s) AS INT) - 1)) AS tr), LATERAL (SELECT unnest(generate_series(CAST(floor(c / s) AS INT), CAST(ceil((c + 1) / s) AS INT) - 1)) AS tc))"""


@check("e12_level_cells", S(
    f'WITH {LEVEL} SELECT scan_id, CAST(tr AS INT) AS "row", CAST(tc AS INT) AS col, {s4("sum(v * wr * wc) / sum(wr * wc)")} AS r FROM f WHERE tr < round_even(100 / s, 0) AND tc < round_even(100 / s, 0) GROUP BY ALL', "v_grid"))
def _level(v):
    want = v.grid.select("scan_id").distinct().withColumn("level", F.lit(2))
    return panorama.level_cells(pano_of(v), want, 100, 100).select("scan_id", "row", "col", r4("r").alias("r"))


PATCH = """pt AS (SELECT a.scan_id, a."row" // 5 AS pr, a.col // 5 AS pc, a.value * 200 ar, a.value * 100 + a.col ag, a."row" + a.value * 50 ab, b.value * 200 br, b.value * 100 + b.col bg, b."row" + b.value * 50 bb
   FROM v_grid a JOIN v_grid b ON b.scan_id = a.scan_id AND b."row" = a."row" AND b.col = a.col + 1 WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
 nc AS (SELECT scan_id, pr, pc, (covar_pop(ar, br) + covar_pop(ag, bg) + covar_pop(ab, bb)) / nullif(sqrt((var_pop(ar) + var_pop(ag) + var_pop(ab)) * (var_pop(br) + var_pop(bg) + var_pop(bb))), 0) AS ncc,
   avg(ar) mar, avg(ag) mag, avg(ab) mab FROM pt GROUP BY ALL)"""


def scored_of(v):
    p = pano_of(v)
    left = p.select("scan_id", "row", "col", *[F.col(c).alias(f"a{c}") for c in "rgb"])
    right = p.select("scan_id", "row", (F.col("col") - 1).alias("col"), *[F.col(c).alias(f"b{c}") for c in "rgb"])
    pt = left.join(right, ["scan_id", "row", "col"]).withColumn("pr", F.floor(F.col("row") / 5).cast("int")).withColumn("pc", F.floor(F.col("col") / 5).cast("int"))
    return panorama.ncc(pt, ["scan_id", "pr", "pc"])


@check("d28_ncc", S(f"WITH {PATCH} SELECT scan_id, pr, pc, {s4('ncc')} AS ncc FROM nc", "v_grid"))
def _d28(v):
    return scored_of(v).select("scan_id", "pr", "pc", r4("ncc").alias("ncc"))


@check("d30_summarise_matches", S(
    f"""WITH {PATCH}, k AS (SELECT scan_id AS pair, avg(ncc) pano_w, count(CASE WHEN ncc > 0.4 THEN 1 END) num_sim, count(CASE WHEN ncc <= 0.4 THEN 1 END) num_diff, count(*) // 2 AS half FROM nc WHERE ncc IS NOT NULL GROUP BY scan_id)
    SELECT pair, {s4('pano_w')} AS pano_w, {s4('1 / (1 + exp(-10 * (half / (9000 * 0.025) - 0.5)))')} AS pano_sig, num_sim, num_diff FROM k""", "v_grid"))
def _d30(v):
    s = scored_of(v).withColumnRenamed("scan_id", "pair")
    n = v.grid.select(F.col("scan_id").alias("pair")).distinct().withColumn("expected", F.lit(9000.0))
    return panorama.summarise_matches(s, n).withColumns({c: r4(c) for c in ("pano_w", "pano_sig")})


@check("k04_panorama_scores")
def _scores(v):
    m = cut(matches_of(v), "matches")
    need = m.select(F.col("src").alias("scan_id"), F.col("src_level").alias("level")).unionByName(
        m.select(F.col("dst").alias("scan_id"), F.col("dst_level").alias("level")))
    p = pano_of(v)
    return panorama.match_scores(m, cut(panorama.level_cells(p, need, 100, 100), "levels"), 100, 100)
