"""Steps whose rows grow faster than the planner sees, or than the input: plans and results."""

import math
import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pointgrid.checks import graph as graph_checks
from pointgrid.checks import panorama as checks
from pointgrid.operators import doors, graph, grids, neighbors, panorama, placement, redact
from pointgrid.views import Views


def sent_whole(df) -> list[str]:
    """Broadcast sides of the plan whose rows were multiplied by an explode."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    deep = [len(re.match(r"[\s:+|-]*", line).group()) for line in lines]
    bad = []
    for i, line in enumerate(lines):
        side = re.search(r"Broadcast\w*Join.*Build(Left|Right)", line)
        if side:
            inner = [j for j in range(i + 1, len(lines)) if all(deep[k] > deep[i] for k in range(i + 1, j + 1))]
            tops = [j for j in inner if deep[j] == min(deep[k] for k in inner)]
            first, second = tops[0], tops[-1]
            part = [j for j in inner if (j < second) == (side.group(1) == "Left")]
            bad += [lines[j].strip() for j in part if re.match(r"[\s:+|-]*Generate", lines[j])]
    return bad


def test_doors_at_one_place_are_one_row(spark):
    doors = spark.range(400).select(
        F.lit(1).alias("scan_id"), F.lit(0).alias("rot"), F.col("id").alias("door_id"), (F.col("id") % 2 * 1.5 + 3.25).alias("cx"),
        F.lit(-2.5).alias("cy"), F.lit(1.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(2.0).alias("w"))
    cands = spark.range(6).select(F.lit(1).alias("scan_id"), F.lit(0).alias("rot"), F.col("id").cast("int").alias("x"), (F.col("id") * 2).cast("int").alias("y"))
    response = spark.createDataFrame([(r, c, 2 if (r + c) % 3 else 1) for r in range(0, 12, 4) for c in range(12)], "row int, col int, value int")
    df = placement.door_agreement(cands, doors, response)
    assert sent_whole(df) == []
    hits = {(r["row"], r["col"]): r["hit"] for r in placement.nearby_response(response).collect()}
    away = lambda v: int(abs(v) + 0.5) * (1 if v > 0 else -1)
    for r in df.collect():
        got = sum(200 * hits.get((away(-2.5 + r["y"]), away(cx + k + r["x"])), 0) for cx in (3.25, 4.75) for k in range(2))
        assert (r["door_uxp"], r["door_count"]) == (800 - got / 2.0, 800.0)
    spots = [j for j in re.findall(r"FileScan parquet \[[^\]]*\bn#", df._jdf.queryExecution().sparkPlan().toString())]
    assert spots, "door points are not counted before they meet the candidates"

def test_only_the_last_of_equal_rectangles_is_blurred(spark):
    image = spark.range(10000).select(F.lit(1).alias("scan_id"), F.floor(F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"),
                                    (F.col("id") % 7).cast("double").alias("r"), (F.col("id") % 5).cast("double").alias("g"), F.lit(1.0).alias("b"))
    odd = F.col("id") % 2 == 1
    of = lambda a, b: F.when(odd, F.lit(b)).otherwise(F.lit(a))
    rects = spark.range(60).select((F.col("id") + 100).alias("rect_id"), F.lit(1).alias("scan_id"), of(0.1, 0.2).alias("x"), F.lit(0.2).alias("y"),
                                   of(0.2, 0.3).alias("width"), of(0.2, 0.1).alias("height"))
    blur = lambda some: redact.redact(image, some, 100, 100, ["r", "g", "b"])
    once, often = blur(rects.where("rect_id >= 158")), blur(rects)
    assert sent_whole(often) == []
    plain = lambda df: sorted((*r[:3], *[round(v, 9) for v in r[3:]]) for r in df.collect())
    assert plain(once) == plain(often)


def test_component_links_are_not_broadcast(spark):
    cells = spark.range(2500).select(F.lit(1).alias("scan_id"), F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col")).where("col % 7 > 0")
    df = grids.components(cells, ["scan_id"])
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    assert df.groupBy("comp").count().agg(F.count("*"), F.max("count"), F.min("count")).first()[:] == (7, 300, 300)


def test_probe_steps_are_not_broadcast(spark):
    voxels = spark.range(20000).select(F.lit(1).alias("scan_id"), (F.col("id") % 100).cast("int").alias("vx"), F.floor(F.col("id") / 100).cast("int").alias("vy"),
                                       F.lit(0).alias("vz"), F.col("id").cast("double").alias("depth"))
    o, z = F.lit(1.0), F.lit(0.0)
    probes = spark.range(50).select("id", F.lit(1).alias("scan_id"), F.col("id").cast("double").alias("px"), (F.col("id") + 10.0).alias("py"), z.alias("pz"), o.alias("ax"), z.alias("ay"), z.alias("az"))
    df = doors.depth_at(probes, voxels, ["id", "scan_id"], 0.8, 0.0)
    assert sent_whole(df) == []
    assert all(r["found"] == (r["id"] + 10) * 100 + r["id"] for r in df.collect())


def _cloud(spark, n, edge):
    """Points on a lattice, several to a place."""
    c = lambda m, d: (F.pmod(F.xxhash64("id", F.lit(d)), F.lit(m)) * edge).alias("xyz"[d])
    return spark.range(n).select((F.col("id") % 2).cast("int").alias("scan_id"), F.col("id").alias("idx"), c(9, 0), c(9, 1), c(9, 2), (F.col("id") % 5 / 10.0).alias("i"))


def test_pairs_of_a_row_are_made_in_one_task(spark):
    p = _cloud(spark, 3000, 0.05)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = neighbors.bucket_join(p.drop("i"), neighbors.positions(p, ["scan_id"]), ["x", "y", "z"], 0.1, ["scan_id"])
        plan = pairs.groupBy("scan_id", *neighbors.CUBE, "idx").agg(F.min("qx"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert "Exchange" not in plan[:plan.index("SortMergeJoin")]


def test_nearest_in_dense_and_crowded_cubes(spark, monkeypatch):
    """Cubes smaller than the limit and parts of a crowded cube give what all pairs give."""
    p = _cloud(spark, 1500, 0.05)
    q = p.where("idx < 200").withColumn("x", F.col("x") + F.when(F.col("idx") % 9 == 0, 0.55).otherwise(0.013))
    pairs = q.crossJoin(p.select(F.col("scan_id").alias("s"), *[F.col(c).alias(f"q{c}") for c in "xyzi"])).where("s = scan_id")
    d2 = neighbors.distance2(["x", "y", "z"]) + F.pow(F.col("i") - F.col("qi"), 2) * 0.25
    want = pairs.withColumn("d2", d2).where("d2 <= 0.16").groupBy("idx").agg(F.min(F.struct("d2", "qx", "qy", "qz")).alias("p")).select("idx", "p.*")
    plain = lambda df: sorted([r["idx"], *[round(r[c], 9) for c in ("d2", "qx", "qy", "qz")]] for r in df.collect())
    monkeypatch.setattr(neighbors, "PART", 16)
    assert neighbors.dense_levels(p, ["x", "y", "z"], 0.4, ["scan_id"]) > 0
    assert plain(neighbors.nearest(q, p, 0.4, ["scan_id"], ["i"], [0.5])) == plain(want)


def test_groups_in_conflict_need_no_pairs(spark):
    """As the walk over all pairs: ties, unlocked rows, missing agreements and rows without a group."""
    import random
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 0.1, 0.2, 0.3, 0.3]), rnd.random() < 0.8, rnd.choice([None, *range(12)])) for i in range(150)]
    n = spark.createDataFrame(rows, "node_id long, agreement double, locked boolean, g int")
    side = lambda s: n.select(F.col("node_id").alias(s), "g")
    pairs = side("a").join(side("b"), "g").where("a <> b").select("a", "b")
    assert sorted(graph.exclude_within(n, ["g"]).collect()) == sorted(graph.exclude_near(n, pairs).collect())


def test_mirrored_edges_are_made_once(spark):
    e = spark.range(4).select(F.col("id").alias("a"), (F.col("id") + 9).alias("b"), F.lit(1).alias("scan_a"), F.lit(2).alias("scan_b"))
    df = graph.mirror(e, {"scan_a": "scan_b", "scan_b": "scan_a"})
    assert "Union" not in df._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r[:] for r in df.collect()) == sorted([(i, i + 9, 1, 2) for i in range(4)] + [(i + 9, i, 2, 1) for i in range(4)])


def test_equal_patches_are_scored_once(spark, sf_dir):
    v = Views(spark, sf_dir)
    m = checks.matches_of(v)
    need = m.select(F.col("src").alias("scan_id"), F.col("src_level").alias("level")).unionByName(m.select(F.col("dst").alias("scan_id"), F.col("dst_level").alias("level")))
    img = panorama.level_cells(checks.pano_of(v), need, 100, 100)
    plain = lambda df: {(r["pair"], r["kp_id"]): (r["n_cells"], r["ncc"] and round(r["ncc"], 9)) for r in df.collect()}
    each = panorama.ncc(panorama.patches(m, img, 100, 100), ["pair", "kp_id"])
    assert plain(panorama.match_scores(m, img, 100, 100)) == plain(each)


def test_minima_are_not_broadcast(spark):
    """The minima of a level grow with the scans: only tables with a row per scan are sent whole."""
    at = spark.range(1600)
    scores = at.select((F.col("id") % 4).cast("int").alias("scan_id"), F.lit(0).alias("rot"), (F.col("id") / 4 % 20).cast("int").alias("x"),
                       F.floor(F.col("id") / 80).cast("int").alias("y"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("score"))
    df = placement.local_minima(scores, ["scan_id", "rot"], F.lit(2))
    assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    rows = scores.collect()
    want = [r[:] for r in rows if not any(o["scan_id"] == r["scan_id"] and abs(o["x"] - r["x"]) <= 2 and abs(o["y"] - r["y"]) <= 2 and o["score"] < r["score"] for o in rows)]
    assert sorted(r[:] for r in df.collect()) == sorted(want)


def test_small_binary_ranges_share_a_frame(tmp_path):
    """Ranges of few points are read from a file opened once and go on together, in any number and order."""
    import numpy as np
    import pandas as pd

    from pointgrid.sources import scans
    record = np.dtype([("p", "<f4", 4), ("c", "u1", 3)])
    files = []
    for k in range(2):
        rec = np.zeros(1050, record)
        rec["p"], rec["c"] = np.arange(4200).reshape(-1, 4) + k, 255 - k
        (tmp_path / f"{k}.bin").write_bytes(np.array([1050, 1], "<i4").tobytes() + rec.tobytes())
        files.append((tmp_path / f"{k}.bin").as_uri())
    ranges = pd.DataFrame([(f, s, min(10, 1050 - s)) for f in files for s in range(0, 1050, 10)][::-1], columns=["file", "start", "count"])
    frames = list(scans._decode(iter([ranges])))
    assert len(frames) == 2
    got = pd.concat(frames).sort_values(["file", "idx"])
    assert got["idx"].tolist() == [*range(1050)] * 2 and got["file"].tolist() == [f for f in files for _ in range(1050)]
    assert got["x"].tolist() == [4.0 * i + k for k in range(2) for i in range(1050)] and set(zip(got["file"], got["r"])) == {(files[0], 255), (files[1], 254)}


def test_nearest_and_the_way_to_the_next(spark):
    """As all pairs: the nearest target, a distance that no other falls below, and rows without one."""
    p = _cloud(spark, 400, 0.05).withColumnRenamed("i", "f")
    q = p.where("idx < 120").withColumn("x", F.col("x") + F.when(F.col("idx") % 9 == 0, 0.7).otherwise(0.013))
    rhs = p.select("scan_id", "x", "y", "z", F.col("f").alias("qf")).distinct()
    got = {r["idx"]: r for r in neighbors.with_nearest(q, rhs, 0.2, 2, ["scan_id"], ["f"], [0.5]).collect()}
    assert len(got) == 120
    targets = [r[:] for r in rhs.collect()]
    for r in q.collect():
        d = sorted(((r["x"] - x) ** 2 + (r["y"] - y) ** 2 + (r["z"] - z) ** 2 + 0.25 * (r["f"] - f) ** 2, x, y, z) for s, x, y, z, f in targets if s == r["scan_id"])
        g = got[r["idx"]]
        if d[0][0] ** 0.5 > 0.2:
            assert g["qx"] is None and g["low"] == 0.2
        else:
            assert (g["qx"], g["qy"], g["qz"]) in [t[1:] for t in d if abs(t[0] - d[0][0]) < 1e-12] and g["low"] <= d[1][0] ** 0.5 + 1e-12


def _closest_points(q, p, rounds, limit):
    """Two fits a round over all pairs, as ``refine`` is defined while its limit stays."""
    import numpy as np

    m = np.eye(4)
    for _ in range(2 * rounds):
        at = q @ m[:3, :3].T + m[:3, 3]
        d = ((at[:, None] - p[None]) ** 2).sum(2)
        near, ok = d.argmin(1), d.min(1) <= limit * limit
        a, b = at[ok], p[near[ok]]
        u, _, vt = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)))
        r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = r, b.mean(0) - r @ a.mean(0)
        m = step @ m
    return m


def test_only_rows_that_may_match_another_target_are_searched_again(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    p = rng.random((200, 3)) * [2, 2, 1]
    q = np.r_[p + [0.03, -0.02, 0.015], rng.random((20, 3)) + 5]
    make = lambda m: spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(m)], "scan_id int, idx long, x double, y double, z double")
    asked, search = [], neighbors.bucket_join
    monkeypatch.setattr(neighbors, "bucket_join", lambda left, *rest: asked.append(left.count()) or search(left, *rest))
    out = neighbors.refine(make(q), make(p), ["scan_id"], rounds=3).first()
    assert np.abs(np.array(out["m"]).reshape(4, 4) - _closest_points(q, p, 3, 0.1)).max() < 1e-9
    first = asked.index(max(asked)) + 1
    assert len(asked) < 12 and sum(asked[first:]) < len(q), asked


def _met(monkeypatch, module) -> list:
    """Row counts of the joins whose rows ``module`` makes pairs of."""
    rows, make = [], module.each_pair
    monkeypatch.setattr(module, "each_pair", lambda pairs, *names: rows.append(pairs.count()) or make(pairs, *names))
    return rows


def test_nodes_with_one_box_are_compared_as_a_bunch(spark, monkeypatch):
    """All columns as by brute force, also with rows that come twice and null scans; a tile's block, a bunch and a tile can be small."""
    box = lambda i: (i % 3 * 30, i % 3 * 30 + 40, 0, 70, -5, 5) if i % 4 == 0 else (20, 10 if i % 9 == 0 else 29, 0, 9, 0, 9)
    rows = [(i, None if i % 50 == 49 else i // 4 % 3, i % 2, box(i)) for i in range(300)]
    rows += rows[40:60]
    nodes = spark.createDataFrame(rows, "node_id long, scan_id int, rot int, box struct<x1: int, x2: int, y1: int, y2: int, z1: int, z2: int>")
    want = Counter()
    for a, sa, ra, u in rows:
        for b, sb, rb, v in rows:
            cross = tuple((min if k % 2 else max)(u[k], v[k]) for k in range(6))
            size = [cross[k + 1] - cross[k] + 1 for k in (0, 2, 4)]
            if a < b and None not in (sa, sb) and sa != sb and min(size) > 0 and all(w[k] <= w[k + 1] for w in (u, v) for k in (0, 2, 4)):
                rel = [tuple(cross[k] - w[k // 2 * 2] for k in range(6)) for w in (u, v)]
                want[a, b, sa, ra, sb, rb, *rel, math.prod(size)] += 1
    plain = lambda df: Counter((*r[:6], *map(tuple, r[6:8]), r[8]) for r in df.collect())
    met = _met(monkeypatch, graph)
    assert plain(graph.overlap_pairs(nodes)) == want
    assert met[0] * 20 < want.total(), "nodes with one box are compared one by one"
    assert plain(graph.overlap_pairs(nodes, tile=16, block=8)) == want


def test_mirroring_builds_no_rows_besides_the_edges(spark):
    e = spark.range(4).select(F.col("id").cast("int").alias("a"), (F.col("id") + 9).cast("int").alias("b"), F.when(F.col("id") > 0, F.col("id") / 2).alias("w"))
    df = graph.mirror(e)
    assert "struct(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.dtypes == e.dtypes
    assert Counter(map(tuple, df.collect())) == Counter(t for i in range(4) for w in [i / 2 if i else None] for t in ((i, i + 9, w), (i + 9, i, w)))


def test_edges_are_normalised_without_comparing_equal_boxes_one_by_one(spark, monkeypatch):
    """The query on candidates with few boxes, against sums over every edge."""
    ids = [4200 * j + i for j in range(60) for i in range(4)]
    rows = [(c, c // 4200 % 3, c % 4, c * 13 % 200, c * 29 % 150) for c in ids]
    place = spark.createDataFrame(rows, "cand_id long, scan_id int, rot int, x int, y int")
    boxes = {r["node_id"]: r["box"] for r in graph_checks.boxes_of(SimpleNamespace(place=place)).collect()}
    scan, edges = {r[0]: r[1] for r in rows}, {}
    for a in ids:
        for b in ids:
            u, v = boxes[a], boxes[b]
            if a < b and scan[a] != scan[b] and all(u[k] <= v[k + 1] and v[k] <= u[k + 1] for k in (0, 2, 4)):
                w = (a * 7 + b * 3) % 101 / 100.0 - 0.2
                edges[a, b] = edges[b, a] = (0.0 if abs(w) < 0.05 else w, (a + b) % 3 * 0.3)
    stats = {}
    for s in range(3):
        for k in range(2):
            x = [e[k] for (a, _), e in edges.items() if scan[a] == s and e[k] != 0]
            m = sum(x) / len(x)
            stats[s, k] = m, math.sqrt(sum((v - m) ** 2 for v in x) / (len(x) - 1))
    norm = lambda v, m, s, low, high: max(-1.0, min(2.5, (v - max(low, min(high, m))) / s)) if v else v
    want = {k: (norm(w, *stats[scan[k[0]], 0], 0.1, 0.6), norm(p, *stats[scan[k[0]], 1], 0.3, 0.7)) for k, (w, p) in edges.items()}
    met = _met(monkeypatch, graph)
    got = graph_checks._d24(SimpleNamespace(place=place)).collect()
    assert max(met) * 20 < len(edges), "nodes with one box are compared one by one"
    assert len(got) == len(want) and {(r["a"], r["b"]): (r["w"], r["pano_w"]) for r in got} == {k: pytest.approx(v, abs=1e-4) for k, v in want.items()}


def test_nodes_at_one_position_are_compared_as_a_bunch(spark, monkeypatch):
    """Pairs as by brute force, also with rows that come twice and nulls; a block may hold fewer nodes than a position."""
    rows = [(i, None if i == 7 else i % 3 * 1.2, -0.0 if i % 2 else 0.0) for i in range(240)] + [(None, 0.0, 0.0), (0, 0.0, 0.0), (500, 0.9, 1.1)]
    nodes = spark.createDataFrame(rows, "node_id long, x double, y double")
    far = lambda u, v: math.dist(u[1:], v[1:])
    real = [r for r in rows if None not in r]
    want = Counter((u[0], v[0]) for u in real for v in real if u[0] != v[0] and far(u, v) < 1.5)
    met = _met(monkeypatch, neighbors)
    assert Counter(map(tuple, neighbors.near_pairs(nodes, 1.0).collect())) == want
    assert met[0] * 20 < want.total(), "nodes at one position are compared one by one"
    assert Counter(map(tuple, neighbors.near_pairs(nodes, 1.0, block=8).collect())) == want
