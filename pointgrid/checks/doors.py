"""Door search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import doors, stats, voxels
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check

VPM = doors.VPM


def _voxels(v):
    return voxels.voxel_running_mean(v.scanpts, VPM)


def _axes(v):
    axis = lambda *c: F.array(*[F.lit(float(x)) for x in c])
    return v.scanpts.select("scan_id").distinct().select("scan_id", axis(0, 0, 1).alias("up"), axis(1, 0, 0).alias("second"), axis(0, 1, 0).alias("third"))


VOXELS = """vx AS (SELECT scan_id, CAST(trunc(x * 50) AS INT) vx, CAST(trunc(y * 50) AS INT) vy, CAST(trunc(z * 50) AS INT) vz, list_reduce(list(sqrt(x*x+y*y+z*z) ORDER BY idx), lambda a, b: (a + b) / 2) AS depth FROM v_scanpts GROUP BY ALL)"""


@check("e16_depth_at", S(
    f"""WITH {VOXELS},
    pb AS (SELECT idx, scan_id, y * 50 + 0.2 AS px, x * 50 - 0.3 AS py, z * 50 + 0.1 AS pz FROM v_scanpts),
    dr AS (SELECT *, 0.0 AS dx, CASE WHEN -py < 0 THEN 1.0 ELSE -1.0 END AS dy FROM pb),
    st AS (SELECT idx, scan_id, o, round(px) AS qx, round(py + i * dy) AS qy, round(pz) AS qz FROM dr, (SELECT 2 * i AS o, i FROM range(41) r(i) UNION ALL SELECT 2 * i + 1, -i FROM range(21) r(i)) t),
    ht AS (SELECT st.idx, st.scan_id, arg_min(depth, o) AS found FROM st JOIN vx ON vx.scan_id = st.scan_id AND vx.vx = qx AND vx.vy = qy AND vx.vz = qz GROUP BY ALL)
    SELECT p.idx, p.scan_id, {s4('coalesce(found, 1e10)')} AS found FROM pb p LEFT JOIN ht USING (idx, scan_id)""", "v_scanpts"))
def _e16(v):
    p = v.scanpts.select("idx", "scan_id", (F.col("y") * VPM + 0.2).alias("px"), (F.col("x") * VPM - 0.3).alias("py"), (F.col("z") * VPM + 0.1).alias("pz"),
                         F.lit(1.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"))
    d = doors.depth_at(p, _voxels(v), ["idx", "scan_id"], 0.8, 0.0, VPM)
    return d.withColumn("found", r4("found"))


@check("e16_line_depths", S(
    f"""WITH {VOXELS},
    pb AS (SELECT idx, scan_id, idx % 4 AS axis, CAST(trunc(x * 50) AS INT) AS ci, CAST(trunc(y * 50) AS INT) AS cj, CAST(trunc(z * 50) AS INT) AS up, CAST(idx % 61 AS INT) - 30 AS off FROM v_scanpts),
    ln AS (SELECT idx, scan_id, axis, up, CASE WHEN axis % 2 = 0 THEN ci ELSE cj END AS u, CASE WHEN axis % 2 = 0 THEN cj ELSE ci END + off AS t FROM pb),
    st AS (SELECT idx, scan_id, o, u, up, axis, t + i * CASE WHEN t > 0 THEN 1 WHEN t < 0 THEN -1 WHEN axis IN (0, 3) THEN -1 ELSE 1 END AS q
      FROM ln, (SELECT 2 * i AS o, i FROM range(41) r(i) UNION ALL SELECT 2 * i + 1, -i FROM range(21) r(i)) m),
    ht AS (SELECT idx, st.scan_id, arg_min(depth, o) AS found FROM st JOIN vx ON vx.scan_id = st.scan_id AND vx.vx = CASE WHEN axis % 2 = 0 THEN u ELSE q END AND vx.vy = CASE WHEN axis % 2 = 0 THEN q ELSE u END AND vx.vz = up GROUP BY ALL)
    SELECT p.idx, p.scan_id, {s4('coalesce(found, 1e10)')} AS found FROM pb p LEFT JOIN ht USING (idx, scan_id)""", "v_scanpts"))
def _lines(v):
    """Probes up to 30 steps beside each point's voxel, looking across it."""
    cell = lambda c: G.trunc(F.col(c) * VPM).cast("int")
    odd, off = F.col("idx") % 2 == 1, (F.col("idx") % 61 - 30).cast("int")
    p = v.scanpts.select(
        "idx", "scan_id", (F.col("idx") % 4).alias("axis"), F.when(odd, cell("x") + off).otherwise(cell("x")).alias("ci"), F.when(odd, cell("y")).otherwise(cell("y") + off).alias("cj"),
        F.lit(0.0).alias("along"), cell("z").cast("double").alias("up"), F.lit(0.0).alias("floor"))
    d = doors.line_depths(p, _voxels(v), _axes(v).withColumnRenamed("up", "up_axis"), ["idx", "scan_id"], 0.8, VPM)
    return d.withColumn("found", r4("found"))


@check("e16_door_limits", S(
    f"""WITH s AS (SELECT scan_id, min(z) AS floor_coord, max(z) - min(z) AS dz FROM v_scanpts GROUP BY scan_id)
    SELECT scan_id, {s4('floor_coord')} AS floor_coord, {s4('greatest(2.1, least(2.6, dz * 0.9)) * 50')} AS h_max, {s4('least(1.8, dz * 0.5) * 50')} AS h_min FROM s""", "v_scanpts"))
def _limits(v):
    s = v.scanpts.groupBy("scan_id").agg(F.min("z").alias("floor_coord"), (F.max("z") - F.min("z")).alias("dz"))
    return doors.door_limits(s).select("scan_id", *[r4(c).alias(c) for c in ("floor_coord", "h_max", "h_min")])


@check("e16_find_doors")
def _find(v):
    s = v.scanpts.groupBy("scan_id").agg(F.min("z").alias("floor_coord"), (F.max("z") - F.min("z")).alias("dz"))
    return doors.find_doors(_voxels(v), _axes(v), doors.door_limits(s))
