"""Graph, ranking and report operators (D22-D27, D32, E04, E13, E15, E18, F04, F06, G, H, K04, K05)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..operators import graph, reports
from ..plans import labelling
from ..stages import cut
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check
from .grids import grid_cells

TOP = "row_number() OVER (PARTITION BY scan_id ORDER BY score, cand_id)"
NODES = f"""nd AS (SELECT cand_id, scan_id, rot, x, y, score, CAST(row_number() OVER (ORDER BY scan_id, rk) - 1 AS INT) AS node_id FROM (SELECT *, {TOP} AS rk FROM v_place) WHERE rk <= 5)"""


def nodes_of(v):
    return graph.select_nodes(v.place, ["score", "cand_id"])


@check("f06_top_per_scan", S(f"SELECT * FROM (SELECT *, CAST({TOP} AS INT) AS rank FROM v_place) WHERE rank <= 12", "v_place"))
def _f06(v):
    return graph.top_per(v.place, ["scan_id"], [F.col("score"), F.col("cand_id")], 12)


@check("g01_sorted_placements", S("SELECT cand_id, scan_id, score FROM v_place ORDER BY score, cand_id", "v_place"))
def _g01(v):
    return v.place.select("cand_id", "scan_id", "score").orderBy("score", "cand_id")


@check("g02_top_fraction", S(
    f"SELECT cand_id, scan_id, score FROM (SELECT *, {TOP} rk, count(*) OVER (PARTITION BY scan_id) n FROM v_place) WHERE rk <= trunc(n * 0.7::DOUBLE) + 1", "v_place"))
def _g02(v):
    return graph.top_fraction(v.place, ["scan_id"], ["score", "cand_id"]).select("cand_id", "scan_id", "score")


@check("g03_select_nodes", S(f"WITH {NODES} SELECT node_id, scan_id, rot, x, y, score FROM nd", "v_place"))
def _g03(v):
    return nodes_of(v).select("node_id", "scan_id", "rot", "x", "y", "score")


@check("g06_sorted_scans", S("SELECT DISTINCT scan_id FROM v_scanpts ORDER BY scan_id", "v_scanpts"))
def _g06(v):
    return v.scanpts.select("scan_id").distinct().orderBy("scan_id")


@check("g07_report_top", S("SELECT cand_id, score FROM v_place ORDER BY score, cand_id LIMIT 20", "v_place"))
def _g07(v):
    return v.place.select("cand_id", "score").orderBy("score", "cand_id").limit(20)


@check("d25_candidates_per_scan", S("SELECT scan_id, count(*) AS n_candidates FROM v_place GROUP BY scan_id", "v_place"))
def _d25(v):
    return graph.candidates_per_scan(v.place)


@check("d26_normalise_nodes", S(
    f"SELECT cand_id, {s4('(1 - score - m) / s')} AS nw FROM v_place JOIN (SELECT scan_id, avg(1 - score) m, stddev_samp(1 - score) s FROM v_place GROUP BY scan_id) USING (scan_id)", "v_place"))
def _d26(v):
    return graph.normalise_nodes(v.place).select("cand_id", r4("nw").alias("nw"))


DELTAS = """dl AS (SELECT scan_id, CAST(row_number() OVER w AS INT) AS rank, score, score - lag(score) OVER w AS delta, CASE WHEN row_number() OVER w > 1 THEN score - first_value(score) OVER w END AS total_delta
  FROM v_place WINDOW w AS (PARTITION BY scan_id ORDER BY cand_id))"""


@check("f04_score_deltas", S(f"WITH {DELTAS} SELECT scan_id, rank, score, {s4('delta')} AS delta, {s4('total_delta')} AS total_delta FROM dl", "v_place"))
def _f04(v):
    d = reports.score_deltas(v.place, ["cand_id"])
    return d.withColumns({c: r4(c) for c in ("delta", "total_delta")})


@check("d27_score_report", S(
    f"""WITH {DELTAS}, m AS (SELECT 'score' AS measure, score AS v FROM dl UNION ALL SELECT 'delta', delta FROM dl WHERE delta > 0.0001 UNION ALL SELECT 'total_delta', total_delta FROM dl WHERE total_delta IS NOT NULL)
    SELECT measure, {s4('min(v)')} AS min, {s4('max(v)')} AS max, {s4('avg(v)')} AS mean, {s4('stddev_samp(v)')} AS sigma FROM m GROUP BY measure""", "v_place"))
def _d27(v):
    r = reports.score_report(v.place, ["cand_id"])
    return r.select("measure", *[r4(c).alias(c) for c in ("min", "max", "mean", "sigma")])


BOXED = """bx AS (SELECT cand_id, scan_id, rot, CAST(trunc(x * (20.0 / 2.0) - 40) AS INT) AS x1, CAST(trunc(y * (20.0 / 2.0) - 30) AS INT) AS y1, -30 + CAST(rot AS INT) * 12 AS z1,
   CAST(cand_id % 20 AS INT) + 10 AS nx, CAST(cand_id % 15 AS INT) + 10 AS ny, CAST(cand_id % 7 AS INT) + 20 AS nz FROM v_place),
 b AS (SELECT cand_id, scan_id, rot, x1, x1 + nx - 1 AS x2, y1, y1 + ny - 1 AS y2, z1, z1 + nz - 1 AS z2, CAST(floor(x1 / 64) AS INT) AS t FROM bx),
 bb AS (SELECT b.*, u FROM b, generate_series(-1, 1) q(k), LATERAL (SELECT t + k AS u)),
 pr AS MATERIALIZED (SELECT a.cand_id AS a, b.cand_id AS b, a.x1 ax, a.y1 ay, greatest(a.x1, b.x1) x1, least(a.x2, b.x2) x2, greatest(a.y1, b.y1) y1, least(a.y2, b.y2) y2, greatest(a.z1, b.z1) z1, least(a.z2, b.z2) z2
   FROM bb a JOIN b ON a.u = b.t AND a.cand_id < b.cand_id AND a.scan_id <> b.scan_id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 AND a.z1 <= b.z2 AND b.z1 <= a.z2)"""


def boxes_of(v):
    c = F.col("cand_id")
    meta = {"zx": F.lit(40), "zy": F.lit(30), "zz": 30 - F.col("rot") * 12, "vox_per_m": F.lit(20.0), "nx": (c % 20 + 10).cast("int"),
            "ny": (c % 15 + 10).cast("int"), "nz": (c % 7 + 20).cast("int")}
    return v.place.withColumns(meta).withColumn("box", G.node_box(F.col("x"), F.col("y"), "", 2.0)).withColumnRenamed("cand_id", "node_id")


@check("e04_overlap_pairs", S(
    f"WITH {BOXED} SELECT a, b, x1 - ax AS x1, x2 - ax AS x2, y1 - ay AS y1, CAST((x2 - x1 + 1) * (y2 - y1 + 1) * (z2 - z1 + 1) AS BIGINT) AS volume FROM pr", "v_place"))
def _e04(v):
    return graph.overlap_pairs(boxes_of(v)).select("a", "b", "box_a.x1", "box_a.x2", "box_a.y1", "volume")


EDGES = f"""{BOXED}, e1 AS (SELECT a, b, (a * 7 + b * 3) % 101 / 100.0 - 0.2 AS w, (a + b) % 3 * 0.3 AS pano_w FROM pr),
 ed AS MATERIALIZED (SELECT a, b, CASE WHEN abs(w) < 0.05 THEN 0 ELSE w END AS w, pano_w FROM (SELECT a, b, w, pano_w FROM e1 UNION ALL SELECT b, a, w, pano_w FROM e1))"""


def edges_of(v):
    p = graph.overlap_pairs(boxes_of(v)).select("a", "b", "scan_a", "scan_b")
    a, b = F.col("a"), F.col("b")
    w = (a * 7 + b * 3) % 101 / 100.0 - 0.2
    e = p.select("a", "b", "scan_a", "scan_b", F.when(F.abs(w) < 0.05, 0.0).otherwise(w).alias("w"), ((a + b) % 3 * 0.3).alias("pano_w"))
    return graph.mirror(e, {"scan_a": "scan_b", "scan_b": "scan_a"})


@check("h03_mirror", S(f"WITH {EDGES} SELECT a, b, {s4('w')} AS w FROM ed", "v_place"))
def _h03(v):
    return edges_of(v).select("a", "b", r4("w").alias("w"))


@check("d24_normalise_edges", S(
    f"""WITH {EDGES}, s AS (SELECT scan_id, avg(CASE WHEN w <> 0 THEN w END) mw, stddev_samp(CASE WHEN w <> 0 THEN w END) sw, avg(CASE WHEN pano_w <> 0 THEN pano_w END) mp, stddev_samp(CASE WHEN pano_w <> 0 THEN pano_w END) sp
      FROM ed JOIN v_place p ON p.cand_id = ed.a GROUP BY scan_id)
    SELECT a, b, {s4('CASE WHEN w <> 0 AND sw > 0 THEN greatest(-1.0, least(2.5, (w - greatest(0.1, least(0.6, mw))) / sw)) ELSE w END')} AS w,
      {s4('CASE WHEN pano_w <> 0 AND sp > 0 THEN greatest(-1.0, least(2.5, (pano_w - greatest(0.3, least(0.7, mp))) / sp)) ELSE pano_w END')} AS pano_w
    FROM ed JOIN v_place p ON p.cand_id = ed.a JOIN s USING (scan_id)""", "v_place"))
def _d24(v):
    e = graph.normalise_edges(edges_of(v), v.place.withColumnRenamed("cand_id", "node_id"))
    return e.select("a", "b", r4("w").alias("w"), r4("pano_w").alias("pano_w"))


SOL = f"""so AS (SELECT scan_id, CASE WHEN scan_id % 5 <> 4 THEN cand_id END AS node_id FROM (SELECT *, {TOP} rk FROM v_place) WHERE rk = 1)"""


def solution_of(v):
    """Best candidate per scan; every fifth scan has no label."""
    best = graph.top_per(v.place, ["scan_id"], [F.col("score"), F.col("cand_id")], 1)
    return best.select("scan_id", F.when(F.col("scan_id") % 5 != 4, F.col("cand_id")).alias("node_id"))


def chosen_edges(v):
    """Dense edges between chosen candidates, one row and column per scan."""
    n = v.place.groupBy("scan_id").agg(F.count("*").alias("n"))
    s = solution_of(v).join(n, "scan_id").where(F.col("node_id").isNotNull()).select("scan_id", "node_id", "n")
    other = s.select((F.col("scan_id") + 1).alias("scan_id"), F.col("node_id").alias("b"), F.col("n").alias("m"))
    e = s.join(other, "scan_id").select(F.col("node_id").alias("a"), "b", ((F.col("n") * 3 + F.col("m")) % 17 / 10.0).alias("weight"))
    return graph.mirror(e)


CHOSEN = f"""{SOL}, sn AS (SELECT so.scan_id, node_id, n FROM so JOIN (SELECT scan_id, count(*) n FROM v_place GROUP BY scan_id) USING (scan_id) WHERE node_id IS NOT NULL),
 c1 AS (SELECT x.node_id AS a, y.node_id AS b, (x.n * 3 + y.n) % 17 / 10.0 AS weight FROM sn x JOIN sn y ON y.scan_id + 1 = x.scan_id), ce AS (SELECT a, b, weight FROM c1 UNION ALL SELECT b, a, weight FROM c1),
 ag AS (SELECT so.scan_id, so.node_id, CASE WHEN so.node_id IS NULL THEN -1000 ELSE coalesce(m, 0) END AS agreement, so.node_id IS NOT NULL AS locked FROM so LEFT JOIN (SELECT b, avg(weight) m FROM ce WHERE weight <> 0 GROUP BY b) e ON e.b = so.node_id)"""


@check("d32_agreement", S(f"WITH {CHOSEN} SELECT scan_id, node_id, {s4('agreement')} AS agreement, locked FROM ag", "v_place"))
def _d32(v):
    return graph.agreement(solution_of(v), chosen_edges(v)).withColumn("agreement", r4("agreement"))


@check("k05_unlock_weak", S(
    f"""WITH {CHOSEN}, st AS (SELECT avg(agreement) m, stddev_samp(agreement) s FROM ag WHERE locked), n AS (SELECT *, (agreement - m) / s AS norm FROM ag, st)
    SELECT scan_id, {s4('norm')} AS norm, locked AND NOT coalesce(norm < -0.75, false) AS locked FROM n""", "v_place"))
def _k05(v):
    s = graph.agreement(solution_of(v), chosen_edges(v)).join(graph.candidates_per_scan(v.place), "scan_id")
    return graph.unlock_weak(s).select("scan_id", r4("norm").alias("norm"), "locked")


@check("e15_exclude_near", S(
    "SELECT cand_id AS node_id, scan_id, score AS agreement, row_number() OVER (PARTITION BY x, y ORDER BY score DESC, cand_id) = 1 AS locked FROM v_place", "v_place"))
def _e15(v):
    # Conflicts inside one pixel are complete, so exactly its best candidate stays locked.
    n = v.place.select(F.col("cand_id").alias("node_id"), "scan_id", F.col("score").alias("agreement"), F.lit(True).alias("locked"), "x", "y")
    return graph.exclude_within(n, ["x", "y"]).drop("x", "y")


@check("e15_exclude_chain", S(
    """WITH n AS (SELECT cand_id, scan_id, score, cand_id // 6 AS c, row_number() OVER (PARTITION BY scan_id, cand_id // 6 ORDER BY cand_id) AS k FROM v_place),
    walk AS (
      SELECT scan_id, c, k, cand_id, score, true AS locked FROM n WHERE k = 1
      UNION ALL
      SELECT n.scan_id, n.c, n.k, n.cand_id, n.score, NOT w.locked OR w.score < n.score FROM walk w JOIN n ON n.scan_id = w.scan_id AND n.c = w.c AND n.k = w.k + 1)
    SELECT w.cand_id AS node_id, w.locked AND NOT coalesce(w.score < x.score, false) AS locked
    FROM walk w LEFT JOIN n x ON x.scan_id = w.scan_id AND x.c = w.c AND x.k = w.k + 1""", "v_place", recursive=True))
def _e15c(v):
    """Conflicts only between neighbours of short chains, where the order of decisions matters."""
    n = v.place.select(F.col("cand_id").alias("node_id"), "scan_id", F.col("score").alias("agreement"), F.lit(True).alias("locked"))
    c = n.withColumn("c", F.floor(F.col("node_id") / 6))
    w = W.partitionBy("scan_id", "c").orderBy("node_id")
    next_ = c.select(F.col("node_id").alias("a"), F.lead("node_id").over(w).alias("b")).dropna()
    return graph.exclude_near(n, graph.mirror(next_)).select("node_id", "locked")


@check("h06_second_round", S(
    f"""WITH {SOL} SELECT cand_id AS node_id, p.scan_id, score, so.node_id IS NOT NULL AS locked FROM v_place p JOIN so ON so.scan_id = p.scan_id WHERE so.node_id IS NULL OR so.node_id = cand_id""", "v_place"))
def _h06(v):
    s = solution_of(v).withColumn("locked", F.col("node_id").isNotNull())
    return graph.second_round(v.place.select(F.col("cand_id").alias("node_id"), "scan_id", "score"), s)


@check("e13_with_attributes", S(
    "WITH m AS (SELECT scan_id, rot, count(*) AS n, max(x) AS mx FROM v_place GROUP BY ALL) SELECT cand_id, n, mx FROM v_place JOIN m USING (scan_id, rot)", "v_place"))
def _e13(v):
    one = v.place.groupBy("scan_id", "rot").agg(F.count("*").alias("n"))
    two = v.place.groupBy("scan_id", "rot").agg(F.max("x").alias("mx"))
    return graph.with_attributes(v.place.select("cand_id", "scan_id", "rot"), one, two).select("cand_id", "n", "mx")


HIGH = f"""{NODES}, fc AS (SELECT DISTINCT k.scan_id, k.rot, g."row" // 4 AS r, g.col // 4 AS c FROM (SELECT DISTINCT scan_id, rot FROM v_place) k JOIN v_grid g ON k.scan_id % 2 = g.scan_id % 2 WHERE g.value > 0.6),
 p0 AS (SELECT node_id, nd.scan_id, r - 5 + y AS pr, c - 7 + x AS pc, exp(-(((c - 7) / 8.0)**2 / 50.0 + ((r - 5) / 8.0)**2 / 50.0)) AS g FROM nd JOIN fc ON fc.scan_id = nd.scan_id AND fc.rot = nd.rot),
 p1 AS (SELECT * FROM p0 WHERE pr BETWEEN 0 AND 149 AND pc BETWEEN 0 AND 199), tw AS (SELECT node_id, sum(g) t FROM p1 GROUP BY node_id),
 wt AS (SELECT p1.*, 1.5 * g / t AS w FROM p1 JOIN tw USING (node_id))"""


def _high(v):
    n = nodes_of(v).withColumn("zx", F.lit(7)).withColumn("zy", F.lit(5))
    return n, grid_cells(v).where("kind = 'mask'").select("scan_id", "rot", "row", "col").distinct()


@check("d22_d23_higher_order", S(
    f"WITH {HIGH} SELECT x.node_id AS a, y.node_id AS b, {s4('-0.5 * sum(x.w + y.w)')} AS h_weight FROM wt x JOIN wt y ON x.pr = y.pr AND x.pc = y.pc AND x.scan_id <> y.scan_id GROUP BY ALL", "v_place", "v_grid"))
def _d22(v):
    n, free = _high(v)
    return graph.higher_order(n, free, 150, 200, 8.0).withColumn("h_weight", r4("h_weight"))


@check("e18_label_graph")
def _e18(v):
    n = graph.normalise_nodes(v.place)
    n = graph.select_nodes(n, ["score", "cand_id"])
    side = lambda s: n.select(F.col("node_id").alias(s), F.col("scan_id").alias(f"s{s}"), F.col("x").alias(f"x{s}"))
    later = side("b").withColumn("sa", F.explode(F.array(F.col("sb") + 1, F.col("sb") + 2)))
    near = side("a").join(later, "sa")
    e = near.select("a", "b", ((F.col("xa") * 3 + F.col("xb") * 7) % 23 / 10.0 - 1.0).alias("weight"))
    return graph.label_graph(n, e)


@check("k04_label_scans")
def _k04(v):
    from .voxels import voxel_files

    kept, vox, meta = voxel_files(v, cut)
    c = kept.groupBy("scan_id").agg(F.count(F.when(F.col("kind") == "point", 1)).alias("c_point"), F.count(F.when(F.col("kind") == "free", 1)).alias("c_free"))
    meta = (meta.join(c, "scan_id").withColumn("rot", F.col("rot").cast("int")))
    n = graph.normalise_nodes(v.place)
    n = cut(graph.select_nodes(n, ["score", "cand_id"]), "nodes")
    zz = n.select("scan_id", "rot").distinct().withColumn("zx", F.lit(7)).withColumn("zy", F.lit(5))
    free = grid_cells(v).where("kind = 'mask'").select("scan_id", "rot", "row", "col").distinct()
    edges, sol = labelling.label_scans(n, vox, meta, free, zz, (150, 200), 20.0)
    return sol.select("scan_id", "node_id", "agreement", "locked")
