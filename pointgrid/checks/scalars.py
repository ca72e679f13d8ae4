"""Scalar functions (C)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import colour
from ..functions import geometry as G
from ..functions import weights as Wt
from ..operators import doors as door_ops
from ..operators import graph, grids, merging, placement
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check

R = "sqrt(x*x + y*y + z*z)"
PHI = f"acos(z / nullif({R}, 0))"


@check("c01_polar", S(f"SELECT idx, {s4(R)} AS r, {s4('atan2(y, x)')} AS theta, {s4(PHI)} AS phi FROM v_scanpts", "v_scanpts"))
def _c01(v):
    r, t, p = G.to_polar(G.vec())
    return v.scanpts.select("idx", r4(r).alias("r"), r4(t).alias("theta"), r4(p).alias("phi"))


@check("c01_cartesian_round_trip", S(
    f"SELECT idx, {s4('x')} AS x, {s4('y')} AS y, {s4('z')} AS z FROM v_scanpts WHERE x*x + y*y + z*z > 0", "v_scanpts"))
def _c01b(v):
    back = G.to_cartesian(*G.to_polar(G.vec()))
    return v.scanpts.where("x*x + y*y + z*z > 0").select("idx", *[r4(c + 1e-9).alias(a) for c, a in zip(back, "xyz")])


PX, PY = "(atan2(y, x) / pi() + 1) * 359.0 / 2", f"{PHI} * 179.0 / 2.61946"


@check("c02_panorama_projection", S(
    f"SELECT idx, CAST(trunc({PX}) AS INT) AS px, CAST(trunc({PY}) AS INT) AS py, {s4(R)} AS r FROM v_scanpts", "v_scanpts"))
def _c02(v):
    px, py, r = G.pano_xy(G.vec(), 360, 180)
    return v.scanpts.select("idx", G.trunc(px).alias("px"), G.trunc(py).alias("py"), r4(r).alias("r"))


@check("c02_panorama_inverse", S(
    f"""WITH a AS (SELECT idx, (2 * x * 20 / 359.0 + 1) * pi() AS t, (y + 2) * 30 * 2.61946 / 179.0 AS p, 1 + intensity AS r FROM v_scanpts)
    SELECT idx, {s4('r * cos(t) * sin(p)')} AS x, {s4('r * sin(t) * sin(p)')} AS y, {s4('r * cos(p)')} AS z FROM a""", "v_scanpts"))
def _c02b(v):
    p = G.pano_inverse(F.col("x") * 20, (F.col("y") + 2) * 30, F.col("intensity") + 1, 360, 180)
    return v.scanpts.select("idx", *[r4(c).alias(a) for c, a in zip(p, "xyz")])


@check("c03_flip_y", S("SELECT idx, x, -y AS y, z FROM v_scanpts", "v_scanpts"))
def _c03(v):
    return v.scanpts.select("idx", *[c.alias(a) for c, a in zip(G.flip_y(G.vec()), "xyz")])


ROT = [math.cos(0.3), -math.sin(0.3), 0.0, math.sin(0.3), math.cos(0.3), 0.0, 0.0, 0.0, 1.0]


def _rows(m, n):
    return [m[n * i:n * i + n] for i in range(n)]


def _rot_sql(m):
    return [f"({a!r}) * x + ({b!r}) * y + ({c!r}) * z" for a, b, c in _rows(m, 3)]


@check("c04_rotate", S("SELECT idx, " + ", ".join(f"{s4(e)} AS {a}" for e, a in zip(_rot_sql(ROT), "xyz")) + ", "
                       + ", ".join(f"{s4(e)} AS i{a}" for e, a in zip(_rot_sql([ROT[3 * j + i] for i in range(3) for j in range(3)]), "xyz"))
                       + " FROM v_scanpts", "v_scanpts"))
def _c04(v):
    m = F.array(*[F.lit(x) for x in ROT])
    return v.scanpts.select("idx", *[r4(c).alias(a) for c, a in zip(G.rotate(G.vec(), m), "xyz")],
                            *[r4(c).alias(f"i{a}") for c, a in zip(G.rotate_inv(G.vec(), m), "xyz")])


H4 = [1.0, 0.2, 0.0, 3.0, -0.2, 1.0, 0.1, -1.0, 0.0, 0.1, 1.0, 0.5, 0.0, 0.0, 0.0, 2.0]


@check("c05_transform4", S("SELECT idx, " + ", ".join(
    s4(f"(({a}) * x + ({b}) * y + ({c}) * z + ({d})) / 2.0") + f" AS {n}" for (a, b, c, d), n in zip(_rows(H4, 4), "xyz")) + " FROM v_scanpts", "v_scanpts"))
def _c05(v):
    m = F.array(*[F.lit(x) for x in H4])
    return v.scanpts.select("idx", *[r4(c).alias(a) for c, a in zip(G.transform4(G.vec(), m), "xyz")])


@check("c06_pose_matrix", S(
    f"""WITH a AS (SELECT idx, x AS ang, y AS tx, z AS ty FROM v_scanpts)
    SELECT idx, {s4('cos(ang)')} AS m00, {s4('-sin(ang)')} AS m01, {s4('tx')} AS m03, {s4('sin(ang)')} AS m10, {s4('cos(ang)')} AS m11,
           {s4('-ty')} AS m13, {s4('1.0')} AS m22, {s4('0.5')} AS m23, {s4('1.0')} AS m33 FROM a""", "v_scanpts"))
def _c06(v):
    a = F.col("x")
    zero = F.lit(0.0)
    # A slightly tilted rotation; flattening must undo the tilt.
    k = F.lit(0.98)
    rot = F.array(F.cos(a) * k, -F.sin(a) * k, F.lit(0.2), F.sin(a) * k, F.cos(a) * k, F.lit(-0.1), zero, zero, F.lit(1.0))
    m = G.pose_matrix(rot, F.array(F.col("y"), F.col("z"), F.lit(0.5)))
    pick = {"m00": 0, "m01": 1, "m03": 3, "m10": 4, "m11": 5, "m13": 7, "m22": 10, "m23": 11, "m33": 15}
    p = v.scanpts.select("idx", m.alias("m"))
    return p.select("idx", *[r4(F.col("m")[i]).alias(n) for n, i in pick.items()])


@check("c07_quantise", S("SELECT idx, CAST(trunc((x + 1) * 20.0) AS INT) AS vx, CAST(trunc((y + 1) * 20.0) AS INT) AS vy, "
                         "CAST(trunc((z + 1) * 20.0) AS INT) AS vz FROM v_scanpts", "v_scanpts"))
def _c07(v):
    return v.scanpts.select("idx", *[G.quantise(F.col(a), F.lit(-1.0), 20.0).alias(f"v{a}") for a in "xyz"])


@check("c08_vectors", S(
    f"""SELECT idx, {s4('nx*0.6 + nz*0.8')} AS d, {s4('ny*0.8')} AS cx, {s4('nz*0.6 - nx*0.8')} AS cy, {s4('-ny*0.6')} AS cz,
    {s4('acos(greatest(least((nx*0.6 + nz*0.8) / (sqrt(nx*nx+ny*ny+nz*nz) * sqrt(0.6*0.6+0.8*0.8)), 1.0), -1.0))')} AS ang, {s4('sqrt(nx*nx+ny*ny+nz*nz) * 2')} AS len FROM v_normals""", "v_normals"))
def _c08(v):
    n, a = G.vec("n"), (F.lit(0.6), F.lit(0.0), F.lit(0.8))
    c = G.cross(n, a)
    return v.normals.select("idx", r4(G.dot(n, a)).alias("d"), *[r4(x).alias(f"c{k}") for x, k in zip(c, "xyz")],
                            r4(G.angle(n, a)).alias("ang"), r4(G.norm(n) * 2).alias("len"))


@check("c09_sigmoid_weight", S(f"SELECT cand_id, {s4('1 / (1 + exp(-10 * (x / 150.0 - 0.5)))')} AS w FROM v_place", "v_place"))
def _c09(v):
    return v.place.select("cand_id", r4(Wt.sigmoid_weight(F.col("x"), F.lit(150.0))).alias("w"))


@check("c10_gaussian_weight", S(f"SELECT cand_id, {s4('exp(-(x*x / (2*50.0*50.0) + y*y / (2*30.0*30.0)))')} AS w FROM v_place", "v_place"))
def _c10(v):
    return v.place.select("cand_id", r4(Wt.gaussian_weight(F.col("x"), F.col("y"), 50.0, 30.0)).alias("w"))


SAT = "CAST(least(greatest(round_even({}, 0), 0), 255) AS INT)"


@check("c11_grey", S(
    "SELECT cand_id, 255 - " + SAT.format("(x - 80.0 - 25.0) / (25.0 * 3.0) * 255.0") + " AS point, 255 - "
    + SAT.format("((y - 60.0) / 25.0 + 1.0) * 255.0") + " AS free FROM v_place", "v_place"))
def _c11(v):
    return v.place.select("cand_id", colour.point_grey(F.col("x"), F.lit(80.0), F.lit(25.0)).alias("point"),
                          colour.free_grey(F.col("y"), F.lit(60.0), F.lit(25.0)).alias("free"))


@check("c12_heat_rgb", S(
    "WITH g AS (SELECT cand_id, " + SAT.format("((score - 0.3) * 8 + 1) / 2 * 255.0") + " AS g FROM v_place) SELECT cand_id, "
    "CASE WHEN g < 128 THEN 0 ELSE (g - 128) * 2 END AS r, CASE WHEN g < 128 THEN g * 2 ELSE 255 - (g - 128) * 2 END AS g, "
    "CASE WHEN g < 128 THEN 255 - g * 2 ELSE 0 END AS b FROM g", "v_place"))
def _c12(v):
    return v.place.select("cand_id", colour.heat_rgb((F.col("score") - 0.3) * 8).alias("c")).select("cand_id", "c.*")


@check("c13_clamped_norm", S(f"SELECT cand_id, {s4('greatest(-1.0, least(2.5, (score - 0.3) / 0.1))')} AS n FROM v_place", "v_place"))
def _c13(v):
    return v.place.select("cand_id", r4(Wt.clamped_norm(F.col("score"), F.lit(0.3), F.lit(0.1))).alias("n"))


@check("c15_placement_score", S(
    f"SELECT cand_id, {s4('(1.5 * x / nullif(x + y, 0) + y / 200.0 + 0.75 * rot / 4.0) / 3.25')} AS s FROM v_place", "v_place"))
def _c15(v):
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    s = Wt.placement_score(x, x + y, y, F.lit(200.0), F.col("rot").cast("double"), F.lit(4.0))
    return v.place.select("cand_id", r4(s).alias("s"))


@check("c16_scan_order", S(
    """SELECT idx, CAST(60 - 1 - idx % 60 AS INT) AS "row", CAST((CAST(trunc((170 - 1) * 0.995 / 2.0) AS BIGINT) - idx // 60) % 170 +
    CASE WHEN (CAST(trunc((170 - 1) * 0.995 / 2.0) AS BIGINT) - idx // 60) % 170 < 0 THEN 170 ELSE 0 END AS INT) AS col FROM v_scanpts""", "v_scanpts"))
def _c16(v):
    row, col = G.scan_order_to_rc(F.col("idx"), 60, 170)
    return v.scanpts.select("idx", row.alias("row"), col.alias("col"))


def _axes(v):
    n = v.normals
    second = (F.col("ny"), -F.col("nx"), F.lit(0.0))
    return n, G.vec("n"), second, G.cross(G.vec("n"), second)


ORDER_SQL = """WITH a AS (SELECT idx, nx a0, ny a1, nz a2, ny b0, -nx b1, 0.0 b2, ny*0 - nz*(-nx) c0, nz*ny - nx*0 c1, nx*(-nx) - ny*ny c2 FROM v_normals),
 o AS (SELECT idx, CASE WHEN abs(a2) > 0.5 THEN a0 ELSE c0 END u0, CASE WHEN abs(a2) > 0.5 THEN a1 ELSE c1 END u1, CASE WHEN abs(a2) > 0.5 THEN a2 ELSE c2 END u2,
   CASE WHEN abs(a2) > 0.5 THEN b0 ELSE a0 END s0, CASE WHEN abs(a2) > 0.5 THEN b1 ELSE a1 END s1, CASE WHEN abs(a2) > 0.5 THEN b2 ELSE a2 END s2 FROM a),
 p AS (SELECT idx, u0 * sg u0, u1 * sg u1, u2 * sg u2, s0, s1, s2 FROM (SELECT *, CASE WHEN u2 < 0 THEN -1.0 ELSE 1.0 END sg FROM o)),
 q AS (SELECT *, u1*s2 - u2*s1 t0, u2*s0 - u0*s2 t1, u0*s1 - u1*s0 t2 FROM p) """


@check("c18_order_axes", S(ORDER_SQL + "SELECT idx, " + ", ".join(f"{s4(f'{k}{i} + 1e-9')} AS {k}{i}" for k in "ust" for i in range(3)) + " FROM q", "v_normals"))
def _c18(v):
    n, a, b, c = _axes(v)
    o = G.order_axes(a, b, c)
    return n.select("idx", *[r4(x + 1e-9).alias(f"{k}{i}") for k, w in zip("ust", o) for i, x in enumerate(w)])


def _ring(k):
    return [("s", 1), ("t", 1), ("s", -1), ("t", -1)][k % 4]


@check("c17_four_rotations", S(ORDER_SQL + " UNION ALL ".join(
    f"SELECT idx, {k} AS rot, " + ", ".join(
        f"{s4(f'{sg} * {n}{i} + 1e-9')} AS m{r}{i}" for r, (n, sg) in enumerate((_ring(k), _ring(k + 1), ("u", 1))) for i in range(3)) + " FROM q"
    for k in range(4)), "v_normals"))
def _c17(v):
    n, a, b, c = _axes(v)
    rots = G.four_rotations(*G.order_axes(a, b, c))
    d = n.select("idx", F.posexplode(rots).alias("rot", "m"))
    return d.select("idx", "rot", *[r4(F.col("m")[3 * r + i] + 1e-9).alias(f"m{r}{i}") for r in range(3) for i in range(3)])


@check("c19_repair_floor", S("SELECT idx, CASE WHEN z > -1.5 OR z < -1.7 THEN -1.6 ELSE z END AS f FROM (SELECT idx, z - 0.5 AS z FROM v_scanpts)", "v_scanpts"))
def _c19(v):
    return v.scanpts.select("idx", Wt.repair_floor(F.col("z") - 0.5).alias("f"))


@check("c20_patch_level", S(
    "SELECT idx, CAST(greatest(0, round(ln((y + 2.5) / (x + 2.5)) / (ln(2) / 3))) AS INT) AS a, "
    "CAST(greatest(0, round(ln((x + 2.5) / (y + 2.5)) / (ln(2) / 3))) AS INT) AS b FROM v_scanpts", "v_scanpts"))
def _c20(v):
    a, b = F.col("x") + 2.5, F.col("y") + 2.5
    return v.scanpts.select("idx", Wt.patch_level(a, b).alias("a"), Wt.patch_level(b, a).alias("b"))


@check("c21_pad_cells", S('SELECT scan_id, "row" + 5 AS "row", col + 5 AS col, value FROM v_grid', "v_grid"))
def _c21(v):
    return grids.pad_cells(v.grid, 100, 100)[0]


def door_table(v):
    d = v.doors
    rot = (F.col("door_id") % 4).cast("int")
    ang = rot * (math.pi / 2)
    st = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, "xyz")])
    return d.select("scan_id", rot.alias("rot"), "door_id",
                    st(F.col("door_id") % 17 / 4.0, F.col("door_id") % 13 / 4.0, F.lit(0.0)).alias("corner"),
                    st(F.cos(ang), F.sin(ang), F.lit(0.0)).alias("x_axis"), st(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("z_axis"), "h", "w")


DOOR_SQL = """dt AS (SELECT scan_id, CAST(door_id % 4 AS INT) AS rot, door_id, door_id % 17 / 4.0 AS kx, door_id % 13 / 4.0 AS ky,
    cos(CAST(door_id % 4 AS INT) * 1.5707963267948966) AS ax, sin(CAST(door_id % 4 AS INT) * 1.5707963267948966) AS ay, h, w FROM v_doors),
 ds AS (SELECT scan_id, rot, door_id, kx * 8.0 + 30 AS cx, ky * 8.0 + 40 AS cy, ax, ay, w * 8.0 AS w FROM dt)"""


def plan_doors_table(v):
    d = door_table(v)
    zz = d.select("scan_id", "rot").distinct().withColumn("zx", F.lit(30)).withColumn("zy", F.lit(40))
    return placement.scale_doors(d, zz, 8.0)


@check("c22_scale_doors", S(f"WITH {DOOR_SQL} SELECT door_id, {s4('cx / 4')} AS cx, {s4('cy / 4')} AS cy, {s4('w / 4')} AS w FROM ds", "v_doors"))
def _c22(v):
    d = placement.doors_at_level(plan_doors_table(v), 2)
    return d.select("door_id", *[r4(c).alias(c) for c in ("cx", "cy", "w")])


@check("c23_door_pixels", S(
    f"WITH {DOOR_SQL} SELECT door_id, k, CAST(round(cx + k * ax + 1e-9) AS INT) AS px, CAST(round(cy + k * ay + 1e-9) AS INT) AS py FROM ds, "
    "generate_series(0, 40) t(k) WHERE k < ceil(w)", "v_doors"))
def _c23(v):
    p = placement.door_pixels(plan_doors_table(v))
    return p.select("door_id", "k", *[F.round(F.col(c) + 1e-9).cast("int").alias(c) for c in ("px", "py")])


META = {"zx": 40, "zy": 30, "zz": 30, "vox_per_m": 20.0}
BOX_SQL = """bx AS (SELECT cand_id, scan_id, rot, CAST(trunc(x * (20.0 / 98.0) - 40) AS INT) AS x1, CAST(trunc(y * (20.0 / 98.0) - 30) AS INT) AS y1, -30 AS z1,
   CAST(cand_id % 20 AS INT) + 10 AS nx, CAST(cand_id % 15 AS INT) + 10 AS ny, CAST(cand_id % 7 AS INT) + 20 AS nz, x, y FROM v_place),
 b AS (SELECT cand_id, scan_id, rot, x1, x1 + nx - 1 AS x2, y1, y1 + ny - 1 AS y2, z1, z1 + nz - 1 AS z2, x, y FROM bx)"""


def boxed(v):
    c = F.col("cand_id")
    d = v.place.withColumns({k: F.lit(x) for k, x in META.items()}).withColumns(
        {"nx": (c % 20 + 10).cast("int"), "ny": (c % 15 + 10).cast("int"), "nz": (c % 7 + 20).cast("int")})
    return d.withColumn("box", G.node_box(F.col("x"), F.col("y"), "", 98.0))


@check("c24_node_box", S(f"WITH {BOX_SQL} SELECT cand_id, x1, x2, y1, y2, z1, z2 FROM b", "v_place"))
def _c24(v):
    return boxed(v).select("cand_id", "box.*")


@check("c25_box_intersect", S(
    f"""WITH {BOX_SQL}, i AS (SELECT cand_id, x1 ox, y1 oy, z1 oz, greatest(x1, -35) x1, least(x2, -15) x2, greatest(y1, -28) y1, least(y2, -10) y2, greatest(z1, -25) z1, least(z2, 0) z2 FROM b)
    SELECT cand_id, x1 - ox AS x1, x2 - ox AS x2, y1 - oy AS y1, y2 - oy AS y2, z1 - oz AS z1, z2 - oz AS z2,
    CAST(greatest(x2 - x1 + 1, 0) AS BIGINT) * greatest(y2 - y1 + 1, 0) * greatest(z2 - z1 + 1, 0) AS volume FROM i""", "v_place"))
def _c25(v):
    other = F.struct(*[F.lit(n).alias(k) for k, n in {"x1": -35, "x2": -15, "y1": -28, "y2": -10, "z1": -25, "z2": 0}.items()])
    d = boxed(v).withColumn("i", G.box_intersect(F.col("box"), other))
    return d.select("cand_id", G.box_relative(F.col("i"), F.col("box")).alias("q"), G.box_volume(F.col("i")).alias("volume")).select(
        "cand_id", "q.*", "volume")


@check("c27_rect_pixels", S(
    "SELECT rect_id, CAST(trunc(x * 800) AS INT) AS px, CAST(trunc(y * 600) AS INT) AS py, CAST(trunc(width * 800) AS INT) AS pw, "
    "CAST(trunc(height * 600) AS INT) AS ph, (0.3 >= x AND 0.3 <= x + width AND 0.4 >= y AND 0.4 <= y + height) AS hit FROM v_rects", "v_rects"))
def _c27(v):
    x, y, w, h = [F.col(c) for c in ("x", "y", "width", "height")]
    p = G.rect_pixels(x, y, w, h, 800, 600)
    return v.rects.select("rect_id", *[c.alias(n) for c, n in zip(p, ("px", "py", "pw", "ph"))],
                          G.rect_contains(x, y, w, h, F.lit(0.3), F.lit(0.4)).alias("hit"))


@check("c29_node_weight", S(f"SELECT cand_id, {s4('1 - score')} AS w FROM v_place", "v_place"))
def _c29(v):
    return v.place.select("cand_id", r4(Wt.node_weight(F.col("score"))).alias("w"))


@check("a09_rotate_doors", S(
    f"WITH {DOOR_SQL} SELECT door_id, {s4('-ky')} AS cx, {s4('-kx')} AS cy, {s4('-ay')} AS ax, {s4('-ax')} AS ay FROM dt", "v_doors"))
def _a09(v):
    # Quarter turn [0 1 0; -1 0 0; 0 0 1]: its transpose maps (x, -y) to (y, x) up to sign.
    d = door_table(v)
    m = F.array(*[F.lit(float(x)) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1)])
    rots = d.select("scan_id").distinct().withColumn("rot", F.lit(1)).withColumn("m", m)
    t = door_ops.rotate_doors(d, rots)
    return t.select("door_id", r4("corner.x").alias("cx"), r4("corner.y").alias("cy"), r4("x_axis.x").alias("ax"), r4("x_axis.y").alias("ay"))
