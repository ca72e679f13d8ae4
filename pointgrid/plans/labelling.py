"""From saved placements to one pose per scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.weights import edge_weight
from ..operators import graph, neighbors, panorama, voxels
from ..operators.filters import keep_edges
from ..stages import cut


def geometric_edges(nodes: DataFrame, grid: DataFrame, meta: DataFrame, scale: float) -> DataFrame:
    """3D agreement edges ``(a, b, w, w_sig, distance)`` of nodes whose boxes meet.

    ``grid`` is the voxel table with ``kind``; ``meta`` the voxel metadata with the kept
    counts ``c_point, c_free``.
    """
    boxed = graph.with_attributes(nodes, meta).withColumn("box", G.node_box(F.col("x"), F.col("y"), "", scale))
    pairs = cut(graph.overlap_pairs(boxed), "pairs")
    counts = boxed.select("node_id", (F.col("c_point") + F.col("c_free")).alias("c"), "x", "y")
    side = lambda s: counts.select(F.col("node_id").alias(s), F.col("c").alias(f"c_{s}"), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    far = F.sqrt(F.pow(F.col("x_a") - F.col("x_b"), F.lit(2.0)) + F.pow(F.col("y_a") - F.col("y_b"), F.lit(2.0))) / scale
    info = both.select("a", "b", (F.col("c_a") + F.col("c_b")).alias("c_sum"), far.alias("distance"))
    agree = voxels.voxel_agreement(pairs, grid)
    e = voxels.agreement_edges(agree, info.select("a", "b", "c_sum"))
    return info.select("a", "b", "distance").join(keep_edges(e), ["a", "b"], "left").select(
        "a", "b", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("w_sig", F.lit(0.0)).alias("w_sig"), "distance")


def panorama_edges(nodes: DataFrame, pairs: DataFrame, keypoints: DataFrame, pano: DataFrame, rotations: DataFrame,
                   pano_meta: DataFrame, scale: float, rows: int, cols: int) -> DataFrame:
    """Panorama agreement ``(a, b, pano_w, pano_sig, num_sim, num_diff)`` of node pairs."""
    at = graph.with_attributes(nodes, rotations).join(pano_meta.select("scan_id", "floor_coord"), "scan_id").select(
        "node_id", "scan_id", "m", F.array(F.col("x") / scale, F.col("y") / scale, F.col("floor_coord")).alias("pos"))
    side = lambda s: at.select(F.col("node_id").alias(s), F.col("scan_id").alias(f"scan_{s}"), F.col("m").alias(f"m_{s}"), F.col("pos").alias(f"pos_{s}"))
    p = cut(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").withColumn("pair", F.struct("a", "b")), "pano-pairs")
    pano = cut(panorama.with_local_depth(pano), "pano")

    def one_way(s: str, d: str):
        t = F.zip_with(f"pos_{s}", f"pos_{d}", lambda u, v: u - v)
        way = p.select("pair", F.col(f"scan_{s}").alias("src"), F.col(f"scan_{d}").alias("dst"),
                       F.col(f"m_{s}").alias("r_src"), F.col(f"m_{d}").alias("r_dst"), t.alias("t"))
        m = cut(panorama.reproject(keypoints, pano, way, rows, cols), "matches")
        need = m.select(F.col("src").alias("scan_id"), F.col("src_level").alias("level")).unionByName(
            m.select(F.col("dst").alias("scan_id"), F.col("dst_level").alias("level")))
        img = cut(panorama.level_cells(pano, need, rows, cols), "levels")
        return panorama.match_scores(m, img, rows, cols).where(
            F.col("n_cells") == panorama.PATCH * panorama.PATCH)

    scored = panorama.drop_white(one_way("a", "b")).unionByName(one_way("b", "a"))
    n = keypoints.groupBy("scan_id").agg(F.count("*").alias("n"))
    k = lambda s: n.select(F.col("scan_id").alias(f"scan_{s}"), F.col("n").alias(f"n_{s}"))
    expected = p.join(k("a"), "scan_a").join(k("b"), "scan_b").select("pair", ((F.col("n_a") + F.col("n_b")) / 2.0).alias("expected"))
    s = panorama.summarise_matches(scored, expected).where(F.col("pano_sig") >= 0.05)
    return s.select("pair.a", "pair.b", "pano_w", "pano_sig", "num_sim", "num_diff")


def combine_edges(geometric: DataFrame, pano: DataFrame, high: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed, normalised edges with their total ``weight``."""
    e = geometric.join(pano, ["a", "b"], "left")
    zero = F.lit(0.0)
    e = e.select("a", "b", "w", "w_sig", F.coalesce("pano_w", zero).alias("pano_w"), F.coalesce("pano_sig", zero).alias("pano_sig"), "distance")
    e = graph.mirror(e).join(high, ["a", "b"], "full")
    e = e.select("a", "b", *[F.coalesce(F.col(c), zero).alias(c) for c in ("w", "w_sig", "pano_w", "pano_sig", "distance", "h_weight")])
    e = graph.normalise_edges(e, nodes)
    return e.withColumn("weight", edge_weight(*[F.col(c) for c in ("w", "w_sig", "pano_w", "pano_sig", "distance", "h_weight")]))


def solve(nodes: DataFrame, edges: DataFrame, scale: float, patience: int = graph.PATIENCE) -> DataFrame:
    """Chosen node, agreement and lock of every scan. Runs jobs."""
    owner = lambda s: nodes.select(F.col("node_id").alias(s), F.col("scan_id").alias(f"s_{s}"))
    later = edges.select("a", "b", "weight").join(owner("a"), "a").join(owner("b"), "b").where("s_a > s_b").select("a", "b", "weight")
    chosen = graph.label_graph(nodes, later, patience)
    sol = graph.agreement(chosen, edges.select("a", "b", "weight")).join(graph.candidates_per_scan(nodes), "scan_id")
    sol = cut(graph.unlock_weak(sol), "solution")
    picked = nodes.join(sol.where("locked").select("node_id"), "node_id", "left_semi")
    return graph.exclude_near(sol, neighbors.near_pairs(picked, scale))


def label_scans(nodes: DataFrame, grid: DataFrame, meta: DataFrame, free_cells: DataFrame, zero_zero: DataFrame,
                plan_size: tuple[int, int], scale: float, keypoints: DataFrame | None = None, pano: DataFrame | None = None,
                rotations: DataFrame | None = None, pano_meta: DataFrame | None = None,
                pano_size: tuple[int, int] | None = None, patience: int = graph.PATIENCE) -> tuple[DataFrame, DataFrame]:
    """Candidate graph and its solution: ``(edges, solution)``. Runs jobs."""
    geo = cut(geometric_edges(nodes, grid, meta, scale), "geometric")
    if keypoints is None:
        pe = geo.select("a", "b", F.lit(0.0).alias("pano_w"), F.lit(0.0).alias("pano_sig"))
    else:
        pe = panorama_edges(nodes, geo.select("a", "b"), keypoints, pano, rotations, pano_meta, scale, *pano_size)
    high = graph.higher_order(nodes.join(zero_zero, ["scan_id", "rot"]), free_cells, *plan_size, scale)
    edges = cut(combine_edges(geo, pe, high, nodes), "edges")
    return edges, solve(nodes, edges, scale, patience)
