"""Sources, sinks and work lists (A). File queries write to the session's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, grids, merging, reports
from ..sources import records, scans, worklists
from ..stages import new_stage_path, ranked, read_stage, write_stage
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check

SCAN_OF = r"scan_id=(\d+)"


def dense_scans(v):
    """Scan points with a dense position per scan and colours."""
    p = ranked(v.scanpts, ["idx"], ["scan_id"], "pos")
    return p.select("scan_id", (F.col("pos") - 1).alias("idx"), "x", "y", "z", "intensity",
                    *[(F.col("idx") % n).cast("short").alias(c) for c, n in (("r", 256), ("g", 199), ("b", 101))])


DENSE = """dp AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY idx) - 1 AS idx, x, y, z, intensity,
  idx % 256 AS r, idx % 199 AS g, idx % 101 AS b FROM v_scanpts)"""
POINTS_SQL = f"WITH {DENSE} SELECT scan_id, idx, {s4('x')} AS x, {s4('y')} AS y, {s4('z')} AS z, {s4('intensity')} AS intensity, r, g, b FROM dp"


def _stored(v):
    path = new_stage_path(v.spark, "ptx")
    pts = dense_scans(v)
    shape = pts.groupBy("scan_id").agg(F.count("*").alias("columns"), F.lit(1).alias("rows"))
    scans.write_ptx(pts, scans.header_lines(shape), path)
    return path


def _out(df):
    return df.select(F.regexp_extract("file", SCAN_OF, 1).cast("int").alias("scan_id"), "idx",
                     *[r4(F.col(c).cast("double")).alias(c) for c in ("x", "y", "z", "intensity")], "r", "g", "b")


@check("a01_ptx_source", S(POINTS_SQL, "v_scanpts"))
def _a01(v):
    return _out(scans.ptx_source(v.spark, _stored(v), per_folder=True))


@check("a02_binary_source", S(POINTS_SQL, "v_scanpts"))
def _a02(v):
    path = new_stage_path(v.spark, "binary")
    scans.write_binary(dense_scans(v), path)
    return _out(scans.binary_point_source(v.spark, path, records=100))


@check("a03_list_files", S("SELECT DISTINCT CAST(scan_id AS INT) AS scan_id FROM v_scanpts", "v_scanpts"))
def _a03(v):
    path = new_stage_path(v.spark, "list")
    v.scanpts.select("scan_id", "x").write.partitionBy("scan_id").parquet(path)
    files = scans.list_files(v.spark, path, F.col("name").contains("part"))
    return files.select(F.regexp_extract("path", SCAN_OF, 1).cast("int").alias("scan_id")).distinct()


NAMES = "nm AS (SELECT idx, CASE WHEN idx % 2 = 0 THEN 'ABC_scan_' || lpad(CAST(scan_id AS VARCHAR), 3, '0') || '.ptx' ELSE 'DEF' || lpad(CAST(scan_id AS VARCHAR), 3, '0') || '.ptx' END AS name, scan_id FROM v_scanpts)"


@check("a04_parse_name", S(
    f"WITH {NAMES} SELECT idx, name, CASE WHEN idx % 2 = 0 THEN 'ABC' ELSE 'DEF' END AS building, lpad(CAST(scan_id AS VARCHAR), 3, '0') AS scan FROM nm", "v_scanpts"))
def _a04(v):
    num = F.lpad(F.col("scan_id").cast("string"), 3, "0")
    name = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("ABC_scan_"), num, F.lit(".ptx"))).otherwise(F.concat(F.lit("DEF"), num, F.lit(".ptx")))
    return scans.with_scan_name(v.scanpts.select("idx", name.alias("name")), "name")


@check("a04_fixed_name", S(f"WITH {NAMES} SELECT idx, name, substr(name, 1, 3) AS building, substr(name, instr(name, '.') - 3, 3) AS scan FROM nm", "v_scanpts"))
def _a04b(v):
    return scans.fixed_name(_a04(v).select("idx", "name"), "name")


@check("a05_select_scans", S(
    "WITH r AS (SELECT scan_id, row_number() OVER (ORDER BY scan_id) - 1 AS ordinal FROM (SELECT DISTINCT scan_id FROM v_scanpts)) SELECT * FROM r WHERE ordinal >= 2 AND ordinal < 6", "v_scanpts"))
def _a05(v):
    return worklists.select_scans(v.scanpts, number=2, count=4)


@check("a06_pending", S(
    "WITH m AS (SELECT scan_id, count(DISTINCT door_id % 3) n FROM v_doors GROUP BY scan_id) SELECT DISTINCT scan_id FROM v_place WHERE scan_id NOT IN (SELECT scan_id FROM m WHERE n >= 3)", "v_place", "v_doors"))
def _a06(v):
    work = v.place.select("scan_id").distinct()
    return worklists.pending(work, v.doors.select("scan_id", (F.col("door_id") % 3).alias("output")), 3)


def _round_trip(v, df, name, by):
    root = new_stage_path(v.spark, "tables")
    write_stage(df, root, name, by)
    wanted = df.select(*by).distinct()
    return read_stage(v.spark, root, name, wanted).select(*df.columns)


@check("a07_rotations_table", S("SELECT CAST(scan_id AS INT) AS scan_id, CAST(rot AS INT) AS rot, x, y FROM v_place", "v_place"))
def _a07(v):
    t = v.place.select("scan_id", "rot", F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("m"))
    return _round_trip(v, t, "rotations", ["scan_id", "rot"]).select("scan_id", "rot", F.col("m")[0].cast("int").alias("x"), F.col("m")[1].cast("int").alias("y"))


@check("a08_normals_table", S(f"SELECT scan_id, idx, {s4('nx')} AS nx, {s4('ny')} AS ny, {s4('nz')} AS nz FROM v_normals", "v_normals"))
def _a08(v):
    t = _round_trip(v, v.normals.select("scan_id", "idx", "nx", "ny", "nz"), "normals", ["scan_id"])
    return t.select("scan_id", "idx", *[r4(f"n{a}").alias(f"n{a}") for a in "xyz"])


@check("a09_doors_table", S("SELECT scan_id, door_id, h, w FROM v_doors", "v_doors"))
def _a09(v):
    return _round_trip(v, v.doors.select("scan_id", "door_id", "h", "w"), "doors", ["scan_id"])


@check("a11_voxels_table", S(
    "SELECT DISTINCT scan_id, CAST(r % 4 AS INT) AS rot, CAST(floor(x * 4) AS INT) AS vx, CAST(floor(y * 4) AS INT) AS vy FROM v_points", "v_points"))
def _a11(v):
    t = v.points.select("scan_id", (F.col("r") % 4).cast("int").alias("rot"), F.floor(F.col("x") * 4).cast("int").alias("vx"), F.floor(F.col("y") * 4).cast("int").alias("vy")).distinct()
    return _round_trip(v, t, "voxels", ["scan_id", "rot"])


@check("a12_panorama_table", S('SELECT scan_id, "row", col, value AS depth FROM v_grid', "v_grid"))
def _a12(v):
    return _round_trip(v, v.grid.withColumnRenamed("value", "depth"), "pano_cells", ["scan_id"])


@check("a15_edges_table", S("SELECT CAST(rot AS INT) AS stage, x AS a, y AS b, score AS w FROM v_place", "v_place"))
def _a15(v):
    return _round_trip(v, v.place.select(F.col("rot").alias("stage"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("score").alias("w")), "edges", ["stage"])


@check("a21_cloud_table", S("SELECT scan_id, idx, x, y, z FROM v_scanpts", "v_scanpts"))
def _a21(v):
    return _round_trip(v, v.scanpts.select("scan_id", "idx", "x", "y", "z"), "cloud", ["scan_id"])


def _zero(v):
    k = v.place.select("scan_id", "rot").distinct()
    return k.withColumn("zx", F.col("scan_id") + 10).withColumn("zy", F.col("rot") + 20)


def _cap_sql(n):
    return (f"SELECT scan_id, CAST(rank AS INT) AS rank, score, x + scan_id + 10 AS x, y + rot + 20 AS y, rot FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score, rot, x, y) AS rank FROM v_place) WHERE rank <= {n}")


def _saved(v):
    path = new_stage_path(v.spark, "placements")
    records.save_placements(v.place, _zero(v), path, 500)
    return path


@check("a13_save_placements", S(_cap_sql(500).replace("CAST(rank AS INT) AS rank, ", ""), "v_place"))
def _a13(v):
    return records.load_placements(v.spark, _saved(v), cap=500).drop("rank")


@check("a14_load_placements", S(_cap_sql(200).replace("CAST(rank AS INT) AS rank, ", ""), "v_place"))
def _a14(v):
    # Ties in the stored score order stay inside the cap only by the stored order, so rank again.
    return records.load_placements(v.spark, _saved(v), cap=200).drop("rank")


@check("a14_true_placements", S(
    "SELECT scan_id, x, y, rot FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score, rot, x, y) AS rank FROM v_place) WHERE rank <= 500", "v_place"))
def _a14b(v):
    return records.load_true_placements(v.spark, _saved(v), _zero(v))


@check("g04_best_placements", S(_cap_sql(500), "v_place"))
def _g04(v):
    return records.best_placements(v.place, _zero(v), 500)


@check("a16_final_poses", S(
    f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score, cand_id) rk FROM v_place) WHERE rk = 1),
    c AS (SELECT x / 98.0 AS cx, y / 98.0 AS cy, -1.6 + scan_id * 0.01 AS cz FROM b ORDER BY scan_id LIMIT 1)
    SELECT scan_id, {s4('x / 98.0 - cx')} AS tx, {s4('y / 98.0 - cy')} AS ty, {s4('-1.6 + scan_id * 0.01 - cz')} AS tz, scan_id % 4 = 0 AS missing, CASE WHEN scan_id % 4 <> 0 THEN rot * 1.0 END AS m0 FROM b, c""", "v_place"))
def _a16(v):
    b = graph.top_per(v.place, ["scan_id"], [F.col("score"), F.col("cand_id")], 1).withColumn("labelled", F.col("scan_id") % 4 != 0)
    rots = v.place.select("scan_id", "rot").distinct().withColumn("m", F.array(*[F.col("rot") * 1.0 for _ in range(9)]))
    meta = v.place.select("scan_id").distinct().withColumn("floor_coord", F.lit(-1.6) + F.col("scan_id") * 0.01)
    p = graph.final_poses(b, rots, meta, 98.0)
    return p.select("scan_id", *[r4(F.col("t")[i]).alias(f"t{a}") for i, a in enumerate("xyz")], F.col("rot").isNull().alias("missing"), F.col("rot")[0].alias("m0"))


def _matrices(v):
    d = v.doors
    cell = lambda k: F.array(*[(F.col("door_id") % 7 + i * k) * 0.25 for i in range(16)])
    return d.groupBy("scan_id").agg(F.max("door_id").alias("door_id")).select("scan_id", cell(1).alias("before"), cell(2).alias("after"))


@check("a17_transform_text", S(
    "WITH d AS (SELECT scan_id, max(door_id) % 7 AS k FROM v_doors GROUP BY scan_id) SELECT scan_id, i AS pos, (k + i) * 0.25 AS before, (k + 2 * i) * 0.25 AS after FROM d, generate_series(0, 15) t(i)", "v_doors"))
def _a17(v):
    path = new_stage_path(v.spark, "transforms")
    records.write_transforms(_matrices(v), path)
    one = lambda s: records.read_transforms(v.spark, path, s).select("scan_id", F.posexplode("m").alias("pos", s))
    return one("before").join(one("after"), ["scan_id", "pos"])


@check("a17_combined_transforms", S(
    "WITH d AS (SELECT scan_id, max(door_id) % 7 AS k FROM v_doors GROUP BY scan_id) SELECT scan_id, i AS pos, (k + i) * 0.25 AS before, (k + 2 * i) * 0.25 AS after FROM d, generate_series(0, 15) t(i)", "v_doors"))
def _a17b(v):
    path = new_stage_path(v.spark, "transforms")
    records.write_combined_transforms(_matrices(v), path)
    one = lambda s: records.read_combined_transforms(v.spark, path, s).select("scan_id", F.posexplode("m").alias("pos", s))
    return one("before").join(one("after"), ["scan_id", "pos"])


@check("a18_rects_from_json", S("SELECT 'ABC' || scan_id AS floor_id, 'ABC_pano_' || rect_id || '.png' AS img_name, 0 AS pos, x, y, width, height FROM v_rects", "v_rects"))
def _a18(v):
    body = F.to_json(F.struct(
        F.array(F.struct("x", "y", "width", "height")).alias("rects"),
        F.struct(F.concat(F.lit("ABC"), F.col("scan_id").cast("string")).alias("floor_id"),
                 F.concat(F.lit("ABC_pano_"), F.col("rect_id").cast("string"), F.lit(".png")).alias("img_name")).alias("img_data")))
    return records.rects_from_json(v.rects.select(body.alias("body")), "body")


@check("a18_read_rects", S("SELECT scan_id, x, y, width, height FROM v_rects", "v_rects"))
def _a18b(v):
    path = new_stage_path(v.spark, "rects")
    records.write_rects(v.rects, path)
    return records.read_rects(v.spark, path)


@check("a19_write_ptx", S(
    f"WITH {DENSE} SELECT scan_id, idx + 10 AS line, printf('%f %f %f %f %d %d %d', x, y, z, intensity, r, g, b) AS value FROM dp", "v_scanpts"))
def _a19(v):
    lines = scans.text_lines(v.spark, _stored(v), per_folder=True).where("line >= 10")
    return lines.select(F.regexp_extract("file", SCAN_OF, 1).cast("int").alias("scan_id"), "line", "value")


@check("a20_scale", S("SELECT CAST(max(x) AS DOUBLE) AS scale FROM v_place", "v_place"))
def _a20(v):
    path = new_stage_path(v.spark, "scale")
    v.place.agg(F.max("x").cast("double").cast("string").alias("value")).write.text(path)
    return records.scale(v.spark, path)


@check("a23_check_inputs", S(
    """WITH l AS (SELECT DISTINCT scan_id, 1 AS points, 0 AS grid, 0 AS place FROM v_scanpts UNION ALL SELECT DISTINCT scan_id, 0, 1, 0 FROM v_grid UNION ALL SELECT DISTINCT scan_id, 0, 0, 1 FROM v_place)
    SELECT * FROM (SELECT scan_id, max(points) AS points, max(grid) AS grid, max(place) AS place FROM l GROUP BY scan_id) WHERE points = 0 OR grid = 0 OR place = 0""", "v_scanpts", "v_grid", "v_place"))
def _a23(v):
    return reports.check_inputs(points=v.scanpts, grid=v.grid, place=v.place)


@check("a24_pair_by_scan", S("SELECT idx, p.scan_id, k FROM v_scanpts p JOIN (SELECT scan_id, max(door_id) AS k FROM v_doors GROUP BY scan_id) USING (scan_id)", "v_scanpts", "v_doors"))
def _a24(v):
    t = v.doors.groupBy("scan_id").agg(F.max("door_id").alias("k"))
    return merging.pair_by_scan(t, v.scanpts.select("idx", "scan_id"))


@check("h01_union_clouds", S("SELECT idx, x, y, z FROM v_scanpts UNION ALL SELECT idx, x + 1, y, z FROM v_scanpts", "v_scanpts"))
def _h01(v):
    a = v.scanpts.select("idx", "x", "y", "z")
    return merging.union_clouds(a, a.withColumn("x", F.col("x") + 1))
