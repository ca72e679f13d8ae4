"""Grid operators (A10, A22, D, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import doors as door_ops
from ..operators import graph, grids
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check

BY = ["scan_id"]
GREY = 'gy AS (SELECT scan_id, "row", col, CAST(coalesce(255 - trunc(value * 255), 255) AS INT) AS grey FROM v_grid)'


def grey_of(v):
    return v.grid.select("scan_id", "row", "col", F.coalesce(255 - F.floor(F.col("value") * 255), F.lit(255)).cast("int").alias("grey"))


@check("a10_coo_encode", S('SELECT scan_id, value, CAST(col AS BIGINT) * 100 + "row" AS "index" FROM v_grid', "v_grid"))
def _a10(v):
    return grids.coo_encode(v.grid, 100)


@check("a10_coo_round_trip", S('SELECT scan_id, "row", col, value FROM v_grid', "v_grid"))
def _a10b(v):
    return grids.coo_decode(grids.coo_encode(v.grid, 100), 100)


@check("a22_grey_to_cells", S(f'WITH {GREY} SELECT scan_id, "row", col, {s4("1 - grey / 255.0")} AS value FROM gy WHERE grey <> 255', "v_grid"))
def _a22(v):
    c = grids.grey_to_cells(grey_of(v))
    return c.withColumn("value", r4("value"))


@check("a22_cells_to_grey", S(
    'SELECT scan_id, "row", col, CAST(trunc(255.0 - value * 255.0 / t) AS INT) AS grey FROM v_grid JOIN (SELECT scan_id, max(value) t FROM v_grid GROUP BY scan_id) USING (scan_id) WHERE value IS NOT NULL', "v_grid"))
def _a22b(v):
    return grids.cells_to_grey(v.grid.where(F.col("value").isNotNull()), BY)


@check("d09_rasterise", S(
    """WITH p AS (SELECT scan_id, idx, CAST(idx % 200 AS INT) r, CAST(idx % 150 AS INT) g, CAST(idx % 100 AS INT) b,
      CAST(trunc(acos(z / nullif(sqrt(x*x+y*y+z*z), 0)) * 59.0 / 2.61946) AS INT) AS "row", CAST(trunc((atan2(y, x) / pi() + 1) * 119.0 / 2) AS INT) AS col FROM v_scanpts)
    SELECT scan_id, "row", col, arg_max(r, idx) AS r, arg_max(g, idx) AS g, arg_max(b, idx) AS b FROM p
    WHERE (r <> 0 OR g <> 0 OR b <> 0) AND "row" BETWEEN 0 AND 59 AND col BETWEEN 0 AND 119 GROUP BY ALL""", "v_scanpts"))
def _d09(v):
    p = v.scanpts.withColumns({c: (F.col("idx") % n).cast("int") for c, n in (("r", 200), ("g", 150), ("b", 100))})
    return grids.rasterise(p, 60, 120, BY).drop("depth")


@check("d10_block_mean", S(
    f'SELECT scan_id, CAST(floor("row" / 8) AS INT) AS "row", CAST(floor(col / 8) AS INT) AS col, {s4("avg(value)")} AS value FROM v_grid WHERE value <> 0 GROUP BY ALL', "v_grid"))
def _d10(v):
    return grids.block_mean(v.grid, BY).withColumn("value", r4("value"))


@check("d11_block_mean_normal", S(
    f"""WITH s AS (SELECT scan_id, CAST(idx % 40 // 8 AS INT) AS "row", CAST(idx // 40 // 8 AS INT) AS col, sum(nx) x, sum(ny) y, sum(nz) z FROM v_normals GROUP BY ALL)
    SELECT scan_id, "row", col, {s4('x / sqrt(x*x+y*y+z*z)')} AS nx, {s4('y / sqrt(x*x+y*y+z*z)')} AS ny, {s4('z / sqrt(x*x+y*y+z*z)')} AS nz FROM s""", "v_normals"))
def _d11(v):
    c = v.normals.withColumn("row", (F.col("idx") % 40).cast("int")).withColumn("col", F.floor(F.col("idx") / 40).cast("int"))
    m = grids.block_mean_normal(c, BY)
    return m.withColumns({f"n{a}": r4(f"n{a}") for a in "xyz"})


@check("d12_pyramid", S(" UNION ALL ".join(
    f'SELECT scan_id, {k} AS level, CAST("row" >> {k} AS INT) AS "row", CAST(col >> {k} AS INT) AS col, max(value) AS value FROM v_grid GROUP BY ALL' for k in range(6)), "v_grid"))
def _d12(v):
    return grids.pyramid(v.grid, 5, BY)


@check("d13_extent", S('SELECT scan_id, min("row") AS min_row, max("row") AS max_row, min(col) AS min_col, max(col) AS max_col FROM v_grid WHERE value > 0.9 GROUP BY scan_id', "v_grid"))
def _d13(v):
    return grids.extent(v.grid.where("value > 0.9"), BY)


@check("d13_trim", S(
    """WITH e AS (SELECT scan_id, min("row") r0, max("row") r1, min(col) c0, max(col) c1 FROM v_grid WHERE value > 0.9 GROUP BY scan_id)
    SELECT scan_id, "row" - r0 AS "row", col - c0 AS col, value FROM v_grid JOIN e USING (scan_id) WHERE "row" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1""", "v_grid"))
def _d13b(v):
    return grids.trim(v.grid, grids.extent(v.grid.where("value > 0.9"), BY), BY)


@check("d13_move_origin", S(
    """WITH e AS (SELECT scan_id, min("row") r0, min(col) c0 FROM v_grid WHERE value > 0.9 GROUP BY scan_id) SELECT scan_id, 50 - c0 AS zx, 60 - r0 AS zy FROM e""", "v_grid"))
def _d13c(v):
    zz = v.grid.select("scan_id").distinct().withColumn("zx", F.lit(50)).withColumn("zy", F.lit(60))
    return grids.move_origin(zz, grids.extent(v.grid.where("value > 0.9"), BY), BY)


COMP_KEYED = """cl AS (SELECT scan_id, "row" AS r, col AS c, CAST("row" AS BIGINT) * 2147483648 + col AS id FROM v_grid WHERE value > 0.4),
 ng AS (SELECT a.scan_id, a.id, b.id AS other FROM cl a, generate_series(-1, 1) q(i), generate_series(-1, 1) w(j), cl b WHERE b.scan_id = a.scan_id AND b.r = a.r + i AND b.c = a.c + j),
 lb(scan_id, id, comp) USING KEY (scan_id, id) AS (SELECT scan_id, id, id FROM cl
   UNION SELECT n.scan_id, n.other, min(l.comp) FROM lb l JOIN ng n ON n.scan_id = l.scan_id AND n.id = l.id JOIN recurring.lb p ON p.scan_id = n.scan_id AND p.id = n.other
   WHERE l.comp < p.comp GROUP BY n.scan_id, n.other)"""


@check("k02_components", S(
    f"WITH {COMP_KEYED} SELECT scan_id, CAST(id >> 31 AS INT) AS \"row\", CAST(id % 2147483648 AS INT) AS col, comp FROM lb", "v_grid", recursive=True))
def _k02(v):
    return grids.components(v.grid.where("value > 0.4"), BY).drop("value")


@check("d14_drop_small_components", S(
    f"""WITH {COMP_KEYED}, sz AS (SELECT scan_id, comp, count(*) n FROM lb GROUP BY ALL), mn AS (SELECT scan_id, avg(n) m FROM sz GROUP BY scan_id)
    SELECT scan_id, CAST(id >> 31 AS INT) AS "row", CAST(id % 2147483648 AS INT) AS col, comp FROM lb JOIN sz USING (scan_id, comp) JOIN mn USING (scan_id) WHERE n >= m""", "v_grid", recursive=True))
def _d14(v):
    return grids.drop_small_components(grids.components(v.grid.where("value > 0.4"), BY), BY).drop("value")


@check("d29_local_mean", S(
    f"""SELECT a.scan_id, a."row", a.col, {s4('coalesce(avg(CASE WHEN b.value <> 0 THEN b.value END), 0)')} AS local_mean FROM v_grid a
    JOIN v_grid b ON b.scan_id = a.scan_id AND b."row" BETWEEN a."row" - 5 AND a."row" + 5 AND b.col BETWEEN a.col - 5 AND a.col + 5 GROUP BY ALL""", "v_grid"))
def _d29(v):
    return grids.local_mean(v.grid, BY).withColumn("local_mean", r4("local_mean"))


FILLED = "fl AS (SELECT * FROM v_grid WHERE value > 0.3)"


@check("d31_erode", S(
    f"""WITH {FILLED} SELECT scan_id, r AS "row", c AS col, max(value) AS value FROM (SELECT scan_id, "row" + i AS r, col + j AS c, value FROM fl,
    generate_series(-2, 2) q(i), generate_series(-2, 2) w(j)) WHERE r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 99 GROUP BY ALL""", "v_grid"))
def _d31(v):
    return grids.erode(v.grid.where("value > 0.3"), BY, 100, 100)


@check("d31_dilate", S(
    """WITH fl AS (SELECT * FROM v_grid WHERE value IS NOT NULL) SELECT scan_id, r AS "row", c AS col, min(value) AS value FROM (SELECT scan_id, "row" + i AS r, col + j AS c, value FROM fl,
    generate_series(-2, 2) q(i), generate_series(-2, 2) w(j)) WHERE r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 99 GROUP BY scan_id, r, c
    HAVING count(*) = (least(r + 2, 99) - greatest(r - 2, 0) + 1) * (least(c + 2, 99) - greatest(c - 2, 0) + 1)""", "v_grid"))
def _d31b(v):
    return grids.dilate(v.grid.where(F.col("value").isNotNull()), BY, 100, 100)


@check("d31_erode_sparse", S(
    f"""WITH {FILLED} SELECT scan_id, r AS "row", c AS col, max(value) AS value FROM (SELECT scan_id, "row" + i AS r, col + j AS c, value FROM fl,
    generate_series(0, 1) q(i), generate_series(0, 1) w(j)) WHERE r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 99 GROUP BY ALL""", "v_grid"))
def _d31c(v):
    return grids.erode_sparse(v.grid.where("value > 0.3"), BY, 100, 100)


@check("f02_inside_mask", S(
    """WITH k AS (SELECT * FROM v_grid WHERE value > 0.99), c AS (SELECT scan_id, col, min("row") r0, max("row") r1 FROM k GROUP BY ALL),
    r AS (SELECT scan_id, "row", min(col) c0, max(col) c1 FROM k GROUP BY ALL)
    SELECT c.scan_id, r."row", c.col FROM c JOIN r ON r.scan_id = c.scan_id AND r."row" BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1""", "v_grid"))
def _f02(v):
    return grids.inside_mask(v.grid.where("value > 0.99"), BY)


def _full(v):
    """Dense grid of every scan: missing cells are empty."""
    size = v.grid.groupBy("scan_id").agg((F.max("row") + 1).alias("n"))
    dense = size.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(99))))
    holes = F.pmod(F.col("row") * 7 + F.col("col") * 3, F.lit(11)) < 6
    return dense.join(v.grid, ["scan_id", "row", "col"], "left").select(
        "scan_id", "row", "col", F.when(holes & (F.col("row") % 9 < 3), None).otherwise(F.col("value")).alias("value"))


DENSE = """dn AS (SELECT s.scan_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, n, CASE WHEN (r * 7 + c * 3) % 11 < 6 AND r % 9 < 3 THEN NULL ELSE value END AS value
   FROM (SELECT scan_id, max("row") + 1 AS n FROM v_grid GROUP BY scan_id) s, LATERAL (SELECT unnest(generate_series(0, s.n - 1)) AS r), generate_series(0, 99) q(c)
   LEFT JOIN v_grid g ON g.scan_id = s.scan_id AND g."row" = r AND g.col = c)"""


def _pass(src: str, out: str, k: int, source: str, keep: str) -> str:
    pos = 'CAST("row" AS BIGINT) * 100 + col' if k < 2 else 'CAST(col AS BIGINT) * n + "row"'
    sign = "" if k % 2 == 0 else "-"
    w = "(PARTITION BY scan_id ORDER BY pos RANGE BETWEEN 15 PRECEDING AND CURRENT ROW)"
    return f"""{out}p AS (SELECT *, {sign}({pos}) AS pos FROM {src}),
 {out}f AS (SELECT scan_id, min(pos) lo, min(CASE WHEN {source} IS NOT NULL THEN pos END) p0, arg_min({source}, pos) FILTER ({source} IS NOT NULL) v0 FROM {out}p GROUP BY scan_id),
 {out}c AS (SELECT p.*, CASE WHEN pos < p0 AND pos < lo + 15 THEN v0 ELSE last_value({source} IGNORE NULLS) OVER {w} END AS carry FROM {out}p p JOIN {out}f USING (scan_id)),
 {out} AS (SELECT scan_id, "row", col, n, orig, {keep} AS value FROM {out}c)"""


def _fill_sql(chained: bool) -> str:
    ctes = [DENSE, "f0 AS (SELECT *, value AS orig FROM dn)"]
    for k in range(4):
        keep = "coalesce(value, carry)" if chained else "CASE WHEN orig IS NOT NULL THEN orig ELSE coalesce(carry, value) END"
        ctes.append(_pass(f"f{k}", f"f{k + 1}", k, "value" if chained else "orig", keep))
    return "WITH " + ", ".join(ctes) + ' SELECT scan_id, "row", col, value FROM f4'


@check("f01_fill_gaps", S(_fill_sql(False), "v_grid"))
def _f01(v):
    return grids.fill_gaps(_full(v), BY)


@check("f01_fill_gaps_chained", S(_fill_sql(True), "v_grid"))
def _f01b(v):
    return grids.fill_gaps(_full(v), BY, chained=True)


@check("f05_first_failing", S(
    'SELECT scan_id, col, min(CASE WHEN value < 0.05 THEN "row" END) AS "first" FROM v_grid GROUP BY scan_id, col', "v_grid"))
def _f05(v):
    return door_ops.first_failing(v.grid, ["scan_id", "col"], "row", F.col("value") < 0.05)


PLACED = """ns AS (SELECT *, row_number() OVER (ORDER BY scan_id, score, cand_id) - 1 AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score, cand_id) rk FROM v_place) WHERE rk <= 5),
 sh AS (SELECT node_id, k AS kind, g."row" // 4 + y - 5 AS r, g.col // 4 + x - 7 AS c FROM ns JOIN v_grid g ON ns.scan_id % 2 = g.scan_id % 2, (VALUES ('scan', 0.9), ('mask', 0.6)) t(k, lim) WHERE g.value > lim)"""


def grid_cells(v):
    """Scan and mask cells of every scan for placed copies of the grid, four times coarser."""
    g = v.grid.withColumn("t", F.explode(F.array(F.struct(F.lit("scan").alias("kind"), F.lit(0.9).alias("lim")), F.struct(F.lit("mask").alias("kind"), F.lit(0.6).alias("lim")))))
    g = g.where(F.col("value") > F.col("t.lim")).select((F.col("scan_id") % 2).alias("half"), F.col("t.kind").alias("kind"), F.floor(F.col("row") / 4).cast("int").alias("row"), F.floor(F.col("col") / 4).cast("int").alias("col"))
    keys = v.place.select("scan_id", "rot").distinct().withColumn("half", F.col("scan_id") % 2)
    return g.join(keys, "half").drop("half")


@check("d33_coverage", S(
    f"""WITH {PLACED} SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col, count(CASE WHEN kind = 'scan' THEN 1 END) AS n_painted, max(CASE WHEN kind = 'scan' THEN node_id END) AS painter,
    max(CASE WHEN kind = 'mask' THEN 1 ELSE 0 END) AS seen FROM sh WHERE r BETWEEN 0 AND 149 AND c BETWEEN 0 AND 199 GROUP BY r, c""", "v_place", "v_grid"))
def _d33(v):
    nodes = graph.select_nodes(v.place, ["score", "cand_id"]).withColumn("zx", F.lit(7)).withColumn("zy", F.lit(5))
    return grids.coverage(nodes.select("node_id", "scan_id", "rot", "x", "y", "zx", "zy"), grid_cells(v), 150, 200)


@check("d34_descriptor_distance", S(
    f"""WITH p AS (SELECT a.vec_id, CAST(a.vec_id % 40 AS INT) AS "row", CAST(a.vec_id // 40 % 40 AS INT) AS col,
      sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: (CAST(t[1] AS DOUBLE) - t[2]) * (CAST(t[1] AS DOUBLE) - t[2])))) AS d
      FROM v_desc a JOIN v_desc b ON b.vec_id = a.vec_id + 1),
    c AS (SELECT "row", col, arg_max(d, vec_id) AS dist FROM p GROUP BY ALL), k AS (SELECT * FROM c WHERE dist <> 0),
    s AS (SELECT avg(dist) m, sqrt((sum(dist*dist) - count(*) * avg(dist) * avg(dist) + (1600 - count(*)) * avg(dist) * avg(dist)) / count(*)) sd FROM k)
    SELECT "row", col, {s4('dist')} AS dist, {s4('(dist - m) / sd')} AS z FROM k, s""", "v_desc"))
def _d34(v):
    i = F.col("vec_id")
    nxt = v.desc.select((i - 1).alias("vec_id"), F.col("embedding").alias("b"))
    p = v.desc.join(nxt, "vec_id").select((i % 40).cast("int").alias("row"), (F.floor(i / 40) % 40).cast("int").alias("col"), i.alias("seq"), F.col("embedding").alias("a"), "b")
    d = grids.descriptor_distance(p, 40, 40)
    return d.select("row", "col", r4("dist").alias("dist"), r4("z").alias("z"))
