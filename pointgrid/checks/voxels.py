"""Voxel and evidence operators (D, E)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import filters, grids, stats, voxels
from ..stages import cut
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check
from .filters import VALID, box_sql

# Check scales: coarse enough that the brute-force SQL stays affordable.
MAP_SCALE, RAY_SCALE, VOXEL_SCALE = 98.0, 6.0, 6.0


def frame_sql(scale: float, slabs: int | None, box: str = "bx", name: str = "fr") -> str:
    zs = f"{slabs} / (z1 - z0)" if slabs else f"{scale}"
    nz = f"{slabs}" if slabs else f"CAST(trunc({scale} * (z1 - z0)) AS INT)"
    return f"""{name}0 AS (SELECT *, {zs} AS zs, CAST(trunc({scale} * (x1 - x0)) AS INT) AS nx, CAST(trunc({scale} * (y1 - y0)) AS INT) AS ny,
       {nz} AS nz FROM {box}),
     {name}1 AS (SELECT *, CAST(trunc(sqrt(2.0) * greatest(nx, ny)) AS INT) AS side FROM {name}0),
     {name} AS (SELECT *, CAST(trunc((side - nx) / 2.0) AS INT) AS dx, CAST(trunc((side - ny) / 2.0) AS INT) AS dy,
       -x0 * {scale} AS ox, -y0 * {scale} AS oy, -z0 * zs AS oz FROM {name}1)"""


def vox_sql(src: str, scale: float, frame: str = "fr", name: str = "vx") -> str:
    return f"""{name}0 AS (SELECT p.scan_id, CAST(trunc((x - x0) * {scale}) AS INT) AS vx, CAST(trunc((y - y0) * {scale}) AS INT) AS vy,
       CAST(trunc((z - z0) * zs) AS INT) AS vz, nx, ny, nz FROM {src} p JOIN {frame} f USING (scan_id)),
     {name} AS (SELECT scan_id, vx, vy, vz, count(*) AS n FROM {name}0 WHERE vx >= 0 AND vx < nx AND vy >= 0 AND vy < ny AND vz >= 0 AND vz < nz
       GROUP BY ALL)"""


def base_sql(scale: float, slabs: int | None) -> str:
    return (f"ok AS ({VALID}), far AS (SELECT * FROM ok WHERE x * x + y * y > 1), {box_sql('far')}, {frame_sql(scale, slabs)}, {vox_sql('ok', scale)}")


def frame_of(v, scale: float, slabs: int | None = voxels.SLABS):
    ok = filters.valid_returns(v.points)
    far = filters.outside_radius(ok)
    box = filters.sigma_box(stats.box_stats(far, ["scan_id"]), (9.0, 9.0, 6.0))
    return ok, voxels.grid_frame(box, scale, slabs)


SAT = "CAST(least(greatest(round_even({}, 0), 0), 255) AS INT)"


@check("s1_point_evidence", S(
    f"WITH {base_sql(MAP_SCALE, 100)}, cl AS (SELECT scan_id, vy AS \"row\", vx AS col, CAST(count(*) AS DOUBLE) AS c FROM vx GROUP BY ALL), "
    "st AS (SELECT scan_id, avg(c) m, stddev_samp(c) s FROM cl GROUP BY scan_id) "
    "SELECT scan_id, \"row\", col, 255 - " + SAT.format("(c - m - s) / (nullif(s, 0) * 3.0) * 255.0") + " AS grey FROM cl JOIN st USING (scan_id)", "v_points"))
def _s1(v):
    ok, frame = frame_of(v, MAP_SCALE)
    return voxels.evidence(voxels.column_counts(ok, frame), "point")


@check("d03_occupancy", S(f"WITH {base_sql(MAP_SCALE, 100)} SELECT scan_id, vx, vy, vz FROM vx", "v_points"))
def _d03(v):
    return voxels.occupancy(*frame_of(v, MAP_SCALE))


@check("d04_voxel_count", S(f"WITH {base_sql(20.0, None)} SELECT scan_id, vx, vy, vz, n FROM vx", "v_points"))
def _d04(v):
    return voxels.voxel_count(*frame_of(v, 20.0, None))


@check("d05_voxel_running_mean", S(
    f"""WITH p AS (SELECT scan_id, idx, CAST(trunc(x * 2) AS INT) vx, CAST(trunc(y * 2) AS INT) vy, CAST(trunc(z * 2) AS INT) vz,
      sqrt(x*x + y*y + z*z) d FROM v_scanpts)
    SELECT scan_id, vx, vy, vz, {s4('list_reduce(list(d ORDER BY idx), lambda a, b: (a + b) / 2)')} AS depth FROM p GROUP BY scan_id, vx, vy, vz""", "v_scanpts"))
def _d05(v):
    d = voxels.voxel_running_mean(v.scanpts, 2.0)
    return d.withColumn("depth", r4("depth"))


RAY = """ry AS (SELECT *, vx - ox AS rx, vy - oy AS ry, vz - oz AS rz, sqrt((vx-ox)*(vx-ox) + (vy-oy)*(vy-oy) + (vz-oz)*(vz-oz)) AS len FROM vx JOIN fr USING (scan_id)),
 ht AS (SELECT scan_id, n, CAST(floor(ox + a * (rx / len)) AS INT) AS vx, CAST(floor(oy + a * (ry / len)) AS INT) AS vy, CAST(floor(oz + a * (rz / len)) AS INT) AS vz,
   nx, ny, nz FROM (SELECT *, unnest(generate_series(0, {last})) AS a FROM ry WHERE {last} >= 0)),
 fs AS (SELECT scan_id, vx, vy, vz, sum(n) AS n FROM ht WHERE vx >= 0 AND vx < nx AND vy >= 0 AND vy < ny AND vz >= 0 AND vz < nz GROUP BY ALL)"""
MARK = RAY.replace("{last}", "CAST(ceil(len) AS INT)")
COUNT = RAY.replace("{last}", "CAST(floor(len * 0.85 - 3.0) - 1 AS INT)")


@check("d06_free_mark", S(f"WITH {base_sql(RAY_SCALE, 12)}, {MARK} SELECT scan_id, vx, vy, vz FROM fs", "v_points"))
def _d06(v):
    ok, frame = frame_of(v, RAY_SCALE, 12)
    return voxels.free_mark(voxels.occupancy(ok, frame), frame)


@check("d07_free_count", S(f"WITH {base_sql(VOXEL_SCALE, None)}, {COUNT} SELECT scan_id, vx, vy, vz, CAST(n AS BIGINT) AS n FROM fs", "v_points"))
def _d07(v):
    ok, frame = frame_of(v, VOXEL_SCALE, None)
    return voxels.free_count(voxels.voxel_count(ok, frame), frame)


@check("b11_threshold_voxels", S(
    f"""WITH {base_sql(VOXEL_SCALE, None)}, {COUNT}, st AS (SELECT scan_id, avg(n) m, stddev_samp(n) s FROM vx GROUP BY scan_id),
    al AS (SELECT 'point' AS kind, * FROM vx UNION ALL SELECT 'free', * FROM fs)
    SELECT kind, scan_id, vx, vy, vz, CAST(n AS BIGINT) AS n FROM al JOIN st USING (scan_id) WHERE (n - m) / s > -1""", "v_points"))
def _b11(v):
    ok, frame = frame_of(v, VOXEL_SCALE, None)
    pts = voxels.voxel_count(ok, frame)
    both = pts.withColumn("kind", F.lit("point")).unionByName(voxels.free_count(pts, frame).withColumn("kind", F.lit("free")))
    return filters.threshold_voxels(both, voxels.voxel_stats(pts, ["scan_id"]), ["scan_id"])


@check("d08_collapse", S(
    f'WITH {base_sql(MAP_SCALE, 100)} SELECT scan_id, vy AS "row", vx AS col, CAST(count(*) AS DOUBLE) AS value FROM vx GROUP BY ALL', "v_points"))
def _d08(v):
    return voxels.collapse(voxels.occupancy(*frame_of(v, MAP_SCALE)))


@check("d35_nonzero", S(f"WITH {base_sql(20.0, None)} SELECT scan_id, count(*) AS n_voxels FROM vx GROUP BY scan_id", "v_points"))
def _d35(v):
    return voxels.nonzero(voxels.voxel_count(*frame_of(v, 20.0, None)), ["scan_id"])


def rotations_of(v):
    """Four upright rotations per scan, each scan at its own angle."""
    s = v.points.select("scan_id").distinct().withColumn("rot", F.explode(F.sequence(F.lit(0), F.lit(3))))
    a = F.col("scan_id") * 0.11 + F.col("rot") * (math.pi / 2)
    z, o = F.lit(0.0), F.lit(1.0)
    return s.select("scan_id", "rot", F.array(F.cos(a), -F.sin(a), z, F.sin(a), F.cos(a), z, z, z, o).alias("m"))


ROT = """rt AS (SELECT scan_id, rot, cos(scan_id * 0.11 + rot * (pi() / 2)) AS c, sin(scan_id * 0.11 + rot * (pi() / 2)) AS s
   FROM (SELECT DISTINCT scan_id FROM v_points), (SELECT unnest(generate_series(0, 3)) AS rot)),
 tg AS (SELECT f.*, rot, c, s, tx, ty FROM fr f JOIN rt USING (scan_id), LATERAL (SELECT unnest(generate_series(0, side - 1)) AS tx), LATERAL (SELECT unnest(generate_series(0, side - 1)) AS ty)),
 sr AS (SELECT scan_id, rot, tx, ty, c * (tx - (ox + dx)) + (-s) * (ty - (oy + dy)) + ox AS sx, s * (tx - (ox + dx)) + c * (ty - (oy + dy)) + oy AS sy, oz FROM tg)"""


@check("e07_rotate_grid_round", S(
    f"WITH {base_sql(RAY_SCALE, 12)}, {ROT} SELECT v.scan_id, rot, CAST(tx AS INT) AS vx, CAST(ty AS INT) AS vy, vz FROM sr JOIN vx v ON v.scan_id = sr.scan_id "
    "AND v.vx = round(sx) AND v.vy = round(sy)", "v_points"))
def _e07(v):
    ok, frame = frame_of(v, RAY_SCALE, 12)
    return voxels.rotate_grid(voxels.occupancy(ok, frame), frame, rotations_of(v), "round")


@check("e07_rotate_grid_trunc", S(
    f"WITH {base_sql(VOXEL_SCALE, None)}, {ROT} SELECT v.scan_id, rot, n, CAST(tx AS INT) AS vx, CAST(ty AS INT) AS vy, tz AS vz FROM sr JOIN vx v ON v.scan_id = sr.scan_id "
    "AND v.vx = floor(sx) AND v.vy = floor(sy), LATERAL (SELECT unnest(generate_series(v.vz, v.vz)) AS tz) WHERE sx >= 0 AND sy >= 0", "v_points"))
def _e07b(v):
    ok, frame = frame_of(v, VOXEL_SCALE, None)
    return voxels.rotate_grid(voxels.voxel_count(ok, frame), frame, rotations_of(v), "trunc")


@check("s1_rotated_evidence", S(
    f"WITH {base_sql(RAY_SCALE, 12)}, {ROT}, rv AS (SELECT v.scan_id, rot, tx, ty, vz FROM sr JOIN vx v ON v.scan_id = sr.scan_id AND v.vx = round(sx) AND v.vy = round(sy)), "
    "cl AS (SELECT scan_id, rot, ty AS \"row\", tx AS col, CAST(count(*) AS DOUBLE) AS c FROM rv GROUP BY ALL), "
    "st AS (SELECT scan_id, rot, avg(c) m, stddev_samp(c) s FROM cl GROUP BY scan_id, rot) "
    "SELECT scan_id, rot, \"row\", col, 255 - " + SAT.format("(c - m - s) / (nullif(s, 0) * 3.0) * 255.0") + " AS grey FROM cl JOIN st USING (scan_id, rot)", "v_points"))
def _s1r(v):
    ok, frame = frame_of(v, RAY_SCALE, 12)
    rot = voxels.rotate_grid(voxels.occupancy(ok, frame), frame, rotations_of(v), "round")
    return voxels.evidence(voxels.collapse(rot), "point")


@check("s2_free_evidence", S(
    f"WITH {base_sql(RAY_SCALE, 12)}, {MARK}, {ROT}, rv AS (SELECT v.scan_id, rot, tx, ty, vz FROM sr JOIN fs v ON v.scan_id = sr.scan_id AND v.vx = round(sx) AND v.vy = round(sy)), "
    "cl AS (SELECT scan_id, rot, ty AS \"row\", tx AS col, CAST(count(*) AS DOUBLE) AS c FROM rv GROUP BY ALL), "
    "st AS (SELECT scan_id, rot, avg(c) m, stddev_samp(c) s FROM cl GROUP BY scan_id, rot), "
    "gr AS (SELECT scan_id, rot, \"row\", col, 255 - " + SAT.format("((c - m) / nullif(s, 0) + 1.0) * 255.0") + " AS grey FROM cl JOIN st USING (scan_id, rot) "
    f"UNION ALL SELECT scan_id, rot, CAST(trunc(oy + dy) AS INT) + j, CAST(trunc(ox + dx) AS INT) + i, 0 FROM fr JOIN rt USING (scan_id), generate_series(-3, 3) a(j), generate_series(-4, 4) b(i) "
    f"WHERE abs(j) < sqrt(0.3 * {RAY_SCALE}::DOUBLE * {RAY_SCALE}::DOUBLE) AND i >= trunc(-sqrt(0.3 * {RAY_SCALE}::DOUBLE * {RAY_SCALE}::DOUBLE - j * j)) AND i < sqrt(0.3 * {RAY_SCALE}::DOUBLE * {RAY_SCALE}::DOUBLE - j * j)) "
    "SELECT scan_id, rot, \"row\", col, min(grey) AS grey FROM gr GROUP BY ALL", "v_points"))
def _s2(v):
    ok, frame = frame_of(v, RAY_SCALE, 12)
    free = voxels.free_mark(voxels.occupancy(ok, frame), frame)
    grey = voxels.evidence(voxels.collapse(voxels.rotate_grid(free, frame, rotations_of(v), "round")), "free")
    return voxels.blacken_origin(grey, frame)


def voxel_files(v, store=lambda df: df):
    """Thresholded, rotated and trimmed voxels with their metadata (stage 2, 3D)."""
    ok, frame = frame_of(v, VOXEL_SCALE, None)
    pts = voxels.voxel_count(ok, frame)
    both = pts.withColumn("kind", F.lit("point")).unionByName(voxels.free_count(pts, frame).withColumn("kind", F.lit("free")))
    kept = store(filters.threshold_voxels(both, voxels.voxel_stats(pts, ["scan_id"]), ["scan_id"]))
    rot = voxels.rotate_grid(kept.drop("n"), frame, rotations_of(v), "trunc")
    vox, meta = voxels.trim_voxels(store(rot), frame, MAP_SCALE)
    return kept, store(vox), store(meta)


FILES = f"""{base_sql(VOXEL_SCALE, None)}, {COUNT}, st AS (SELECT scan_id, avg(n) m, stddev_samp(n) s FROM vx GROUP BY scan_id),
 al AS (SELECT kind, scan_id, vx, vy, vz FROM (SELECT 'point' AS kind, * FROM vx UNION ALL SELECT 'free', * FROM fs) JOIN st USING (scan_id) WHERE (n - m) / s > -1),
 {ROT}, rv AS (SELECT v.scan_id, rot, kind, CAST(tx AS INT) AS vx, CAST(ty AS INT) AS vy, vz FROM sr JOIN al v ON v.scan_id = sr.scan_id AND v.vx = floor(sx) AND v.vy = floor(sy) WHERE sx >= 0 AND sy >= 0),
 ex AS (SELECT scan_id, rot, min(vx) lx, max(vx) hx, min(vy) ly, max(vy) hy, min(vz) lz, max(vz) hz FROM rv WHERE kind = 'point' GROUP BY ALL)"""


@check("s3_voxel_files", S(
    f"WITH {FILES} SELECT scan_id, rot, kind, vx - lx AS vx, vy - ly AS vy, vz - lz AS vz FROM rv JOIN ex USING (scan_id, rot) "
    "WHERE vx BETWEEN lx AND hx AND vy BETWEEN ly AND hy AND vz BETWEEN lz AND hz", "v_points"))
def _s3(v):
    return voxel_files(v)[1]


@check("s3_voxel_meta", S(
    f"WITH {FILES} SELECT scan_id, rot, CAST(trunc(ox) AS INT) + dx - lx AS zx, CAST(trunc(oy) AS INT) + dy - ly AS zy, CAST(trunc(oz) AS INT) - lz AS zz, "
    f"hx - lx + 1 AS nx, hy - ly + 1 AS ny, hz - lz + 1 AS nz, {VOXEL_SCALE} AS vox_per_m, {MAP_SCALE} AS px_per_m FROM ex JOIN fr USING (scan_id)", "v_points"))
def _s3m(v):
    return voxel_files(v)[2]


PAIR_SHIFT = 3


def _agreement_input(v):
    """Scan s against s + 1 of the kept voxels, moved by a fixed offset."""
    ok, frame = frame_of(v, VOXEL_SCALE, None)
    pts = voxels.voxel_count(ok, frame)
    both = pts.withColumn("kind", F.lit("point")).unionByName(voxels.free_count(pts, frame).withColumn("kind", F.lit("free")))
    vox = cut(both.select("scan_id", F.lit(0).alias("rot"), "kind", "vx", "vy", "vz"), "voxels")
    size = frame.select("scan_id", "nx", "ny", "nz")
    right = size.select((F.col("scan_id") - 1).alias("scan_id"), *[F.col(f"n{a}").alias(f"m{a}") for a in "xyz"])
    p = size.join(right, "scan_id")
    hi = {a: F.least(F.col(f"n{a}") - (PAIR_SHIFT if a != "z" else 0), F.col(f"m{a}")) - 1 for a in "xyz"}

    def box(off):
        return F.struct(*[x.alias(n) for a in "xyz" for x, n in (
            (F.lit(off if a != "z" else 0), f"{a}1"), (hi[a] + (off if a != "z" else 0), f"{a}2"))])

    pairs = p.select(F.col("scan_id").alias("a"), (F.col("scan_id") + 1).alias("b"), F.col("scan_id").alias("scan_a"), F.lit(0).alias("rot_a"),
                     (F.col("scan_id") + 1).alias("scan_b"), F.lit(0).alias("rot_b"), box(PAIR_SHIFT).alias("box_a"), box(0).alias("box_b"))
    return pairs, vox


AGREE = f"""{base_sql(VOXEL_SCALE, None)}, {COUNT}, al AS (SELECT 'point' AS kind, scan_id, vx, vy, vz FROM vx UNION ALL SELECT 'free', scan_id, vx, vy, vz FROM fs),
 pr AS (SELECT a.scan_id AS a, b.scan_id AS b, least(a.nx - {PAIR_SHIFT}, b.nx) - 1 AS mx, least(a.ny - {PAIR_SHIFT}, b.ny) - 1 AS my, least(a.nz, b.nz) - 1 AS mz FROM fr a JOIN fr b ON b.scan_id = a.scan_id + 1),
 sv AS (SELECT a, b, 'a' AS sd, kind, vx - {PAIR_SHIFT} AS ux, vy - {PAIR_SHIFT} AS uy, vz AS uz, mx, my, mz FROM pr JOIN al ON al.scan_id = pr.a
   UNION ALL SELECT a, b, 'b', kind, vx, vy, vz, mx, my, mz FROM pr JOIN al ON al.scan_id = pr.b),
 inb AS (SELECT * FROM sv WHERE ux BETWEEN 0 AND mx AND uy BETWEEN 0 AND my AND uz BETWEEN 0 AND mz),
 dl AS (SELECT DISTINCT a, b, sd, ux + i AS ux, uy + j AS uy, uz FROM sv, generate_series(-2, 2) q(i), generate_series(-2, 2) w(j) WHERE kind = 'point'),
 ce AS (SELECT a, b, ux, uy, uz, max(CASE WHEN sd = 'a' AND kind = 'point' THEN 1 ELSE 0 END) pa, max(CASE WHEN sd = 'b' AND kind = 'point' THEN 1 ELSE 0 END) pb,
   max(CASE WHEN sd = 'a' AND kind = 'free' THEN 1 ELSE 0 END) fa, max(CASE WHEN sd = 'b' AND kind = 'free' THEN 1 ELSE 0 END) fb FROM inb GROUP BY ALL),
 sl AS (SELECT a, b, uz FROM sv WHERE uz BETWEEN 0 AND mz GROUP BY a, b, uz HAVING count(DISTINCT sd) = 2),
 fl AS (SELECT ce.*, CASE WHEN (pb = 1 AND da.ux IS NOT NULL) OR (pa = 1 AND db.ux IS NOT NULL) THEN 1 ELSE 0 END ag FROM ce
   SEMI JOIN sl USING (a, b, uz)
   LEFT JOIN dl da ON da.a = ce.a AND da.b = ce.b AND da.ux = ce.ux AND da.uy = ce.uy AND da.uz = ce.uz AND da.sd = 'a'
   LEFT JOIN dl db ON db.a = ce.a AND db.b = ce.b AND db.ux = ce.ux AND db.uy = ce.uy AND db.uz = ce.uz AND db.sd = 'b'),
 ag AS (SELECT a, b, sum(ag) agree, sum(pa * fb) free_a, sum(pb * fa) free_b, sum(fa * fb) free_cross, sum(pa) total_a, sum(pb) total_b, sum(pa + pb + fa + fb) total FROM fl GROUP BY a, b)"""


@check("e05_e06_voxel_agreement", S(f"WITH {AGREE} SELECT a, b, agree, free_a, free_b, free_cross, total_a, total_b, total FROM ag", "v_points"))
def _e05(v):
    return voxels.voxel_agreement(*_agreement_input(v))


@check("s7_agreement_edges", S(
    f"""WITH {AGREE}, cs AS (SELECT scan_id, count(*) c FROM al GROUP BY scan_id),
    e AS (SELECT a, b, agree / ((total_a + total_b) / 2.0) p_a, free_a / total_a fe_a, free_b / total_b fe_b, total, x.c + y.c c FROM ag JOIN cs x ON x.scan_id = a JOIN cs y ON y.scan_id = b WHERE total_a > 0 AND total_b > 0)
    SELECT a, b, {s4('p_a - (fe_b + fe_a)')} AS w, {s4('1 / (1 + exp(-10 * (total / (c / 2.0 * 0.5) - 0.5)))')} AS w_sig FROM e""", "v_points"))
def _s7(v):
    pairs, vox = _agreement_input(v)
    c = vox.groupBy("scan_id").agg(F.count("*").alias("c"))
    side = lambda s: c.select(F.col("scan_id").alias(s), F.col("c").alias(f"c{s}"))
    meta = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("ca") + F.col("cb")).alias("c_sum"))
    e = voxels.agreement_edges(voxels.voxel_agreement(pairs, vox), meta)
    return e.select("a", "b", r4("w").alias("w"), r4("w_sig").alias("w_sig"))


@check("e21_descriptor_at", S(
    "SELECT e.event_id, d.vec_id AS feature_id, CAST(embedding[1] AS DOUBLE) AS first FROM events e LEFT JOIN v_desc d ON d.vec_id = e.event_id", "v_desc"))
def _e21(v):
    vox = lambda i: [(i % 10).cast("int").alias("vx"), (F.floor(i / 10) % 10).cast("int").alias("vy"), F.floor(i / 100).cast("int").alias("vz")]
    pts = v.table("events").select(F.lit(0).alias("scan_id"), "event_id", *vox(F.col("event_id")))
    feats = v.desc.select(F.lit(0).alias("scan_id"), *vox(F.col("vec_id")), F.col("vec_id").alias("feature_id"))
    desc = v.desc.select(F.col("vec_id").alias("feature_id"), "embedding")
    return voxels.descriptor_at(pts, feats, desc).select("event_id", "feature_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@check("e22_merge_grids", S(
    "SELECT scan_id, CAST(floor(x * 4) AS INT) AS vx, CAST(floor(y * 4) AS INT) AS vy, count(*) AS n FROM v_points GROUP BY ALL", "v_points"))
def _e22(v):
    def half(k):
        p = v.points.where(F.col("r") % 2 == k)
        return p.groupBy("scan_id", F.floor(F.col("x") * 4).cast("int").alias("vx"), F.floor(F.col("y") * 4).cast("int").alias("vy")).agg(F.count("*").alias("n"))

    return voxels.merge_grids(half(0), half(1), ["scan_id", "vx", "vy"], F.sum("n").alias("n"))
