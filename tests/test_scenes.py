"""Small scenes with known answers for operators that SQL cannot state."""

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointgrid.functions import geometry as G
from pointgrid.operators import doors, graph, grids, neighbors, placement, stats, voxels
from pointgrid.plans import labelling, merging, placing
from pointgrid.sources import records
from pointgrid import stages
from pointgrid.stages import ranked


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rank_inside_hot_group(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    got = {(r["g"], r["v"]): r["rank"] for r in ranked(df, ["v"], ["g"]).collect()}
    for g in (0, 1):
        vs = sorted(v for k, v in got if k == g)
        assert [got[g, v] for v in vs] == list(range(1, len(vs) + 1))


def test_running_mean_of_one_hot_voxel(spark):
    n = 20000
    d = [1.0 + (i * 37 % 101) / 100 for i in range(n)]
    pts = spark.createDataFrame([(0, i, d[i], 0.0, 0.0) for i in range(n)], "scan_id int, idx long, x double, y double, z double")
    v = d[0]
    for x in d[1:]:
        v = (v + x) / 2
    got = voxels.voxel_running_mean(pts, 0.1).collect()
    assert len(got) == 1 and got[0]["depth"] == pytest.approx(v, abs=1e-12)


def test_fill_gaps_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(grids, "FILL_BLOCK", 16)
    size, limit = 12, 5
    rng = np.random.default_rng(3)
    m = rng.random((size, size))
    m[rng.random((size, size)) < 0.8] = np.nan
    cells = [(0, r, c, None if math.isnan(m[r, c]) else float(m[r, c])) for r in range(size) for c in range(size)]

    def carry(order, mask, out):
        cur = next((m[p] for p in order if mask[p]), None)
        count = 0
        for p in order:
            if mask[p]:
                cur, count = m[p], 0
            else:
                if count < limit:
                    out[p] = cur
                count += 1

    mask = ~np.isnan(m)
    want = m.copy()
    rm = [(r, c) for r in range(size) for c in range(size)]
    cm = [(r, c) for c in range(size) for r in range(size)]
    for order in (rm, rm[::-1], cm, cm[::-1]):
        carry(order, mask, want)
    df = spark.createDataFrame(cells, "scan_id int, row int, col int, value double")
    for r in grids.fill_gaps(df, ["scan_id"], limit).collect():
        w = want[r["row"], r["col"]]
        assert (r["value"] is None) == bool(np.isnan(w))
        if r["value"] is not None:
            assert r["value"] == pytest.approx(w)


def test_three_components(spark):
    spots = [(0, 0)] + [(3, c) for c in range(4)] + [(r, c) for r in range(7, 11) for c in range(5, 10)]
    df = spark.createDataFrame([(0, r, c, 1.0) for r, c in spots], "scan_id int, row int, col int, value double")
    lab = grids.components(df, ["scan_id"])
    assert sorted(r["count"] for r in lab.groupBy("comp").count().collect()) == [1, 4, 20]
    assert grids.drop_small_components(lab, ["scan_id"]).count() == 20


def test_rotation_four_quarter_turns_is_identity(spark):
    frame = spark.createDataFrame([(0, -2.0, 2.0, -2.0, 2.0, -1.0, 1.0)], "scan_id int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    frame = voxels.grid_frame(frame, 4.0, 8)
    vox = spark.createDataFrame([(0, i, (i * 5) % 16, i % 8) for i in range(16)], "scan_id int, vx int, vy int, vz int")
    eye = spark.createDataFrame([(0, k, [float(x) for x in np.linalg.matrix_power(np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]]), k).ravel()]) for k in range(5)], "scan_id int, rot int, m array<double>")
    got = voxels.rotate_grid(vox, frame, eye)
    one = rows(got.where("rot = 0"), "vx", "vy", "vz")
    assert one == rows(got.where("rot = 4"), "vx", "vy", "vz") and len(one) == 16


def test_voxel_agreement_of_tall_grids_against_brute_force(spark):
    rng = np.random.default_rng(8)
    size, tall = 7, 140
    grid = {(s, k): {tuple(int(x) for x in q) for q in rng.integers(0, (size, size, tall), (260, 3))} for s in (0, 1) for k in ("point", "free")}
    grid[0, "point"] = {q for q in grid[0, "point"] if q[2] % 9}
    grid[0, "free"] = {q for q in grid[0, "free"] if q[2] % 9}
    vox = spark.createDataFrame([(s, 0, k, *q) for (s, k), qs in grid.items() for q in qs], "scan_id int, rot int, kind string, vx int, vy int, vz int")
    lo_a, lo_b, ext = (1, 0, 37), (0, 2, 5), (5, 4, 99)
    box = lambda lo: {n: v for a, l, e in zip("xyz", lo, ext) for n, v in ((f"{a}1", l), (f"{a}2", l + e))}
    kind = "struct<x1:int,x2:int,y1:int,y2:int,z1:int,z2:int>"
    pairs = spark.createDataFrame([(3, 4, 0, 0, 1, 0, box(lo_a), box(lo_b))], f"a int, b int, scan_a int, rot_a int, scan_b int, rot_b int, box_a {kind}, box_b {kind}")
    got = voxels.voxel_agreement(pairs, vox).first().asDict()
    want = dict.fromkeys(("agree", "free_a", "free_b", "free_cross", "total_a", "total_b", "total"), 0)
    filled = {s: {q[2] for k in ("point", "free") for q in grid[s, k]} for s in (0, 1)}
    close = lambda s, q: any((q[0] + i, q[1] + j, q[2]) in grid[s, "point"] for i in range(-2, 3) for j in range(-2, 3))
    for u in itertools.product(*[range(e + 1) for e in ext]):
        qa, qb = tuple(x + y for x, y in zip(u, lo_a)), tuple(x + y for x, y in zip(u, lo_b))
        if qa[2] not in filled[0] or qb[2] not in filled[1]:
            continue
        pa, fa, pb, fb = qa in grid[0, "point"], qa in grid[0, "free"], qb in grid[1, "point"], qb in grid[1, "free"]
        want["agree"] += (pb and close(0, qa)) or (pa and close(1, qb))
        want["free_a"] += pa and fb
        want["free_b"] += pb and fa
        want["free_cross"] += fa and fb
        want["total_a"] += pa
        want["total_b"] += pb
        want["total"] += pa + fa + pb + fb
    assert {k: got[k] for k in want} == want


def test_pyramid_keeps_the_maximum(spark):
    df = spark.createDataFrame([(0, r, c, float((r * 31 + c * 17) % 97)) for r in range(13) for c in range(9)], "scan_id int, row int, col int, value double")
    tops = {r["level"]: r["m"] for r in grids.pyramid(df, 3, ["scan_id"]).groupBy("level").agg(F.max("value").alias("m")).collect()}
    assert len(set(tops.values())) == 1


def test_knn_against_brute_force_with_copies(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random((60, 3)) * 3, np.repeat(rng.random((1, 3)), 15, 0), rng.random((5, 3)) * 40])
    df = spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(p)], "scan_id int, idx long, x double, y double, z double")
    got = {r["idx"]: r["mean_dist"] for r in neighbors.mean_distance(df, 4, ["scan_id"]).collect()}
    for i in range(len(p)):
        d = np.sort(np.sqrt(((p - p[i]) ** 2).sum(1)))[1:5]
        assert got[i] == pytest.approx(d.mean(), abs=1e-9)
    whole = {r["idx"]: r["mean_dist"] for r in neighbors.mean_distance(df, 4, []).collect()}
    assert whole == pytest.approx(got)


def _radial(n, seed=4):
    """Points whose density falls with the square of the distance, as around a scanner, with a few far away."""
    rng = np.random.default_rng(seed)
    d = rng.standard_normal((n, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    return np.concatenate([d * (rng.random((n, 1)) * 20 + 1e-4), rng.random((6, 3)) * 300 + 100])


def test_knn_where_density_falls_with_distance(spark):
    """Exact rows of queries in and out of the cloud, and no cube that a query looks into holds many."""
    p = _radial(1500)
    df = spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(p)], "scan_id int, idx long, x double, y double, z double")
    rng = np.random.default_rng(8)
    ask = np.concatenate([p[:200], rng.random((20, 3)) * 500 - 250])
    queries = spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(ask)] + [(1, 999, 0.0, 0.0, 0.0)], df.schema)
    k = 12
    got = {}
    for r in neighbors.knn(queries, df, k, ["scan_id"]).collect():
        got.setdefault(r["idx"], []).append(r["d2"])
    assert set(got) == set(range(len(ask)))
    for i, q in enumerate(ask):
        assert sorted(got[i]) == pytest.approx(np.sort(((p - q) ** 2).sum(1))[:k], abs=1e-9)
    data = neighbors.positions(df, ["scan_id"])
    tree = neighbors.Octree(data, ["scan_id"])
    placed = tree.placed(data.drop("n"))
    crowd = math.ceil(neighbors.CROWD * k)
    crowded = tree.crowded(placed, 1)
    level = {(r["x"], r["y"], r["z"]): r["level"] for r in tree.levels(placed, crowded.where(F.col("n") >= crowd)).collect()}
    assert len(set(level.values())) >= 4
    load = {(r["level"], r["_cx"], r["_cy"], r["_cz"]): r["n"] for r in crowded.collect()}
    grid = {tuple(r[a] for a in "xyz"): [r[g] for g in neighbors._GRID] for r in placed.collect()}
    own = lambda q: (level[q], *[g >> (neighbors.LEVELS - level[q]) for g in grid[q]])
    most = max(load.get(own(tuple(map(float, q))), 0) for q in p)
    single = Counter(tuple(np.floor(q / 2.0)) for q in p)  # one size that gives an average point its neighbours
    assert most < crowd < max(single.values())


def test_knn_of_one_hot_position(spark):
    """A position that a third of all points share is one row, asked once."""
    p = np.concatenate([_radial(60)[:60], np.repeat([[0.5, 0.5, 0.5]], 40, 0)])
    df = spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(p)], "scan_id int, idx long, x double, y double, z double")
    rows = neighbors.knn(df, df, 5, ["scan_id"]).where("idx >= 60").collect()
    assert len(rows) == 40 and all(r["n"] == 40 and r["d2"] == 0 for r in rows)
    assert neighbors.knn(df.where("false"), df, 5, ["scan_id"]).count() == 0
    assert neighbors.knn(df, df.where("false"), 5, ["scan_id"]).count() == 0
    assert neighbors.knn(df, df.where("false"), 5, []).count() == 0


def test_rotation_in_expressions_is_the_best(spark):
    """Against singular values: general clouds, planes, reflections, half turns; a line gives no turn."""
    rng = np.random.default_rng(1)
    rows, want = [], []
    for k in range(60):
        p = rng.standard_normal((40, 3)) * [1, 1, 0 if k % 3 == 0 else 1]
        q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
        q = np.diag([-1.0, -1.0, 1.0]) if k == 5 else q * np.sign(np.linalg.det(q)) if k % 4 else q
        d = p @ q.T + rng.standard_normal((40, 3)) * 0.01
        c = (p - p.mean(0)).T @ (d - d.mean(0)) / 40
        u, _, vt = np.linalg.svd(c)
        want.append(vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T)
        rows.append((k, *map(float, c.ravel())))
    line = np.outer([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])
    rows += [(60, *map(float, line.ravel())), (61, *[0.0] * 9)]
    names = ", ".join(f"s{a}{b} double" for a in "xyz" for b in "xyz")
    got = {r["k"]: np.array([r[f"r{i}"] for i in range(9)]).reshape(3, 3) for r in G.with_rotation(spark.createDataFrame(rows, f"k int, {names}")).collect()}
    for k in range(60):
        assert np.abs(got[k] - want[k]).max() < 1e-5, k
    assert np.abs(got[61] - np.eye(3)).max() == 0 and np.abs(got[60] @ got[60].T - np.eye(3)).max() < 1e-9


def test_refine_recovers_a_small_motion(spark):
    rng = np.random.default_rng(9)
    p = np.concatenate([np.c_[rng.random((300, 2)) * 2, np.zeros(300)], np.c_[rng.random(300) * 2, np.zeros(300), rng.random(300) * 2], np.c_[np.zeros(300), rng.random((300, 2)) * 2]])
    a = 0.01
    rot = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    q = p @ rot.T + [0.01, -0.008, 0.005]
    make = lambda m: spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(m)], "scan_id int, idx long, x double, y double, z double")
    out = neighbors.refine(make(q), make(p), ["scan_id"], rounds=4).first()
    assert out["ok"] and not out["settled"]  # four rounds cannot show four equal ones before
    m = np.array(out["m"]).reshape(4, 4)
    back = q @ m[:3, :3].T + m[:3, 3]
    assert np.abs(back - p).max() < 2e-3


def test_refine_gives_up_on_a_large_motion(spark):
    pts = [(0, i, i % 7 * 0.5, i // 7 * 0.5, 0.1 * (i % 3)) for i in range(49)]
    src = spark.createDataFrame(pts, "scan_id int, idx long, x double, y double, z double")
    dst = src.withColumn("x", F.col("x") + 0.22)
    out = neighbors.refine(src, dst, ["scan_id"], rounds=3, limit=0.4).first()
    assert not out["ok"] and out["m"][3] == 0.0


def test_shifted_scan_is_placed_where_it_was_cut(spark):
    rng = np.random.default_rng(1)
    plan = np.where(rng.random((64, 64)) < 0.15, 0.95, 0.0)
    plan[[0, -1], :] = plan[:, [0, -1]] = 0.95
    y0, x0, n = 22, 34, 24
    cells = lambda m, *key: [(*key, int(r), int(c), float(m[r, c])) for r, c in zip(*np.nonzero(m))]
    plan_df = spark.createDataFrame(cells(plan), "row int, col int, value double")
    crop = plan[y0:y0 + n, x0:x0 + n]
    scans = spark.createDataFrame([t for k in range(4) for t in cells(np.rot90(crop, k), 5, k)], "scan_id int, rot int, row int, col int, value double")
    masks = spark.createDataFrame([(5, k, r, c, 1.0) for k in range(4) for r in range(n) for c in range(n)], "scan_id int, rot int, row int, col int, value double")
    got = placing.place_scans(plan_df, (64, 64), scans, masks, (n, n), levels=1, erosion=False).orderBy("score").first()
    first = np.nonzero(crop.any(1))[0][0], np.nonzero(crop.any(0))[0][0]
    assert (got["rot"], got["y"] - first[0], got["x"] - first[1]) == (0, y0, x0)


def test_plan_image_is_cleaned_and_padded_before_placing(spark):
    """Specks go, the sheet grows by a tenth, and the scan is found at its place on the larger sheet."""
    rng = np.random.default_rng(4)
    plan = np.zeros((64, 64))
    plan[[0, -1], :] = plan[:, [0, -1]] = plan[20, :40] = plan[:31, 27] = plan[41, 10:] = plan[41:, 50] = plan[20:42, 13] = 1.0
    free = [(r, c) for r in range(64) for c in range(64) if not plan[max(r - 1, 0):r + 2, max(c - 1, 0):c + 2].any()]
    specks = {free[i] for i in rng.choice(len(free), 25, replace=False)}
    grey = [(int(r), int(c), 0) for r, c in zip(*np.nonzero(plan))] + [(r, c, 60) for r, c in specks] + [(r, c, 255) for r, c in free if (r, c) not in specks]
    img = spark.createDataFrame(grey, "row int, col int, grey int")
    front, rows, cols = placing.plan_front(img.withColumn("scan_id", F.lit(0)), 64, 64)
    assert (rows, cols) == (70, 70)
    assert {(r["row"], r["col"]) for r in front.collect()} == {(r + 3, c + 3) for r, c in zip(*np.nonzero(plan))}
    y0, x0, n = 14, 8, 30
    crop = plan[y0:y0 + n, x0:x0 + n]
    scans = [(5, k, int(r), int(c), 1.0) for k in range(4) for r, c in zip(*np.nonzero(np.rot90(crop, k)))]
    masks = [(5, k, r, c, 1.0) for k in range(4) for r in range(n) for c in range(n)]
    make = lambda rows: spark.createDataFrame(rows, "scan_id int, rot int, row int, col int, value double")
    got = placing.place_on_image(img, (64, 64), make(scans), make(masks), (n, n), levels=1, erosion=False).orderBy("score").first()
    first = np.nonzero(crop.any(1))[0][0], np.nonzero(crop.any(0))[0][0]
    assert (got["rot"], got["y"] - first[0], got["x"] - first[1]) == (0, y0 + 3, x0 + 3)


def test_true_placements_count_from_the_template(spark, tmp_path):
    rows = [(s, r, x, 9 - x, x / 10) for s in range(2) for r in range(2) for x in range(5)]
    place = spark.createDataFrame(rows, "scan_id int, rot int, x int, y int, score double")
    zero = spark.createDataFrame([(s, r, 7 * s + 1, 5 * r + 2) for s in range(2) for r in range(2)], "scan_id int, rot int, zx int, zy int")
    records.save_placements(place, zero, str(tmp_path / "p"), 500)
    got = records.load_true_placements(spark, str(tmp_path / "p"), zero)
    assert sorted(tuple(r) for r in got.select("scan_id", "rot", "x", "y").collect()) == sorted(r[:4] for r in rows)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_running_mean_folds_as_deep_as_ids_ask(spark, monkeypatch, chunk):
    monkeypatch.setattr(voxels, "FOLD_CHUNK", chunk)
    d = [1.0 + (i * 37 % 11) / 10 for i in range(82)]
    pts = spark.createDataFrame([(i % 2, i, d[i], 0.0, 0.0) for i in range(82)], "scan_id int, idx long, x double, y double, z double")
    want = []
    for s in (0, 1):
        v = d[s]
        for x in d[s + 2::2]:
            v = (v + x) / 2
        want.append(v)
    got = voxels.voxel_running_mean(pts, 0.1).orderBy("scan_id").collect()
    assert [r["depth"] for r in got] == pytest.approx(want, abs=1e-12)
    assert voxels.voxel_running_mean(pts.where("false"), 0.1).count() == 0


def test_local_minima_against_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = [(0, int(r), int(x), int(y), float(s)) for r, x, y, s in zip(rng.integers(0, 2, 400), rng.integers(-20, 40, 400), rng.integers(-20, 40, 400), rng.integers(0, 60, 400) / 60)]
    df = spark.createDataFrame(pts, "scan_id int, rot int, x int, y int, score double")
    want = sorted({p for p in pts if not any(q[1] == p[1] and abs(q[2] - p[2]) <= 4 and abs(q[3] - p[3]) <= 4 and q[4] < p[4] for q in pts)})
    got = sorted({tuple(r) for r in placement.local_minima(df, ["scan_id", "rot"], F.lit(4)).select("scan_id", "rot", "x", "y", "score").collect()})
    assert got == want


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_labels_reach_the_best_value_on_small_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    nodes = [(s * 2 + k, s, float(rng.normal())) for s in range(3) for k in range(2)]
    edges = [(a[0], b[0], float(rng.normal())) for a in nodes for b in nodes if a[1] > b[1]]
    w = {(a, b): v for a, b, v in edges}
    n_df = spark.createDataFrame(nodes, "node_id int, scan_id int, nw double")
    e_df = spark.createDataFrame(edges, "a int, b int, weight double")

    def value(pick):
        total = sum(-1.0 if p is None else 0.75 * nodes[p][2] for p in pick)
        for i, j in itertools.combinations(range(3), 2):
            total += -10.0 if pick[i] is None or pick[j] is None else w[pick[j], pick[i]]
        return total

    best = max(value(p) for p in itertools.product(*[[s * 2, s * 2 + 1, None] for s in range(3)]))
    got = {r["scan_id"]: r["node_id"] for r in graph.label_graph(n_df, e_df).collect()}
    assert value([got[s] for s in range(3)]) == pytest.approx(best)


def test_unlinked_scans_share_the_cost_of_having_no_label(spark):
    n_df = spark.createDataFrame([(0, 0, -10.0), (1, 1, -10.0)], "node_id int, scan_id int, nw double")
    e_df = spark.createDataFrame([], "a int, b int, weight double")
    assert {r["node_id"] for r in graph.label_graph(n_df, e_df).collect()} == {None}


@pytest.mark.parametrize("seed", range(1))
def test_sparse_graphs_reach_the_best_value(spark, seed):
    rng = np.random.default_rng(seed + 10)
    nodes = [(s * 2 + k, s, float(rng.normal(0, 4))) for s in range(4) for k in range(2)]
    linked = {(0, 1), (1, 2)}
    edges = [(a[0], b[0], float(rng.normal())) for a in nodes for b in nodes if (b[1], a[1]) in linked]
    w = {(a, b): v for a, b, v in edges}
    n_df = spark.createDataFrame(nodes, "node_id int, scan_id int, nw double")
    e_df = spark.createDataFrame(edges, "a int, b int, weight double")

    def value(pick):
        total = sum(-1.0 if p is None else 0.75 * nodes[p][2] for p in pick)
        for i, j in itertools.combinations(range(4), 2):
            total += -10.0 if pick[i] is None or pick[j] is None else w.get((pick[j], pick[i]), 0.0)
        return total

    best = max(value(p) for p in itertools.product(*[[s * 2, s * 2 + 1, None] for s in range(4)]))
    got = {r["scan_id"]: r["node_id"] for r in graph.label_graph(n_df, e_df).collect()}
    assert value([got[s] for s in range(4)]) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(2))
def test_near_nodes_are_excluded_pair_by_pair(spark, seed):
    rng = np.random.default_rng(seed)
    agreement = [1.0, 2.0, 3.0] if not seed else [float(x) for x in rng.integers(0, 5, 25)]
    n = len(agreement)
    near = {(0, 1), (1, 2)} if not seed else {tuple(sorted(p)) for p in rng.integers(0, n, (40, 2)).tolist() if p[0] != p[1]}
    locked = [True] * n
    for a, b in sorted(near):
        if locked[a] and locked[b]:
            locked[a if agreement[a] < agreement[b] else b] = False
    sol = spark.createDataFrame([(i, i, g, True) for i, g in enumerate(agreement)], "scan_id int, node_id int, agreement double, locked boolean")
    pairs = spark.createDataFrame([*near, *((b, a) for a, b in near)], "a int, b int")
    got = {r["node_id"]: r["locked"] for r in graph.exclude_near(sol, pairs).collect()}
    assert [got[i] for i in range(n)] == locked


def test_box_room_axes_and_floor(spark):
    rng = np.random.default_rng(4)
    n = 400
    up = np.c_[rng.normal(0, 0.002, (n, 2)), np.ones(n)]
    side = np.c_[np.ones(n // 2), rng.normal(0, 0.002, (n // 2, 2))]
    back = np.c_[rng.normal(0, 0.002, n // 4), np.ones(n // 4), rng.normal(0, 0.002, n // 4)]
    v = np.concatenate([up, side, back])
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(v)], "scan_id int, idx long, nx double, ny double, nz double")
    one = stats.dominant_direction(df)
    two = stats.dominant_pair(df, one)
    a, b = one.first(), two.first()
    assert abs(a["mz"]) > 0.999 and abs(b["mx"]) > 0.999 and abs(b["py"]) > 0.999
    z = [-1.6 + 0.005 * (i % 3) for i in range(300)] + [1.0 + 0.005 * (i % 3) for i in range(200)] + [float(x) for x in rng.uniform(-1.4, 0.9, 100)]
    pts = spark.createDataFrame([(0, x) for x in z], "scan_id int, z double")
    planes = stats.floor_and_span(stats.peel_values(pts, ["scan_id"], "z"), ["scan_id"]).first()
    assert planes["floor_coord"] == pytest.approx(-1.595, abs=0.01) and planes["dz"] == pytest.approx(2.6, abs=0.01)


def test_door_in_a_wall_is_found(spark):
    vpm, cells = 10.0, {}
    # A wall along x at y = 20 with an opening 10 wide and 20 high, seen from the origin.
    for x in range(-20, 31):
        for z in range(-16, 11):
            if not (0 <= x < 10 and -16 <= z < 4):
                cells[x, 20, z] = math.sqrt(x * x + 400 + z * z) / vpm
    vox = spark.createDataFrame([(0, *k, d) for k, d in cells.items()] + [(0, 0, 0, 0, 0.1)], "scan_id int, vx int, vy int, vz int, depth double")
    axes = spark.createDataFrame([(0, [0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "scan_id int, up array<double>, second array<double>, third array<double>")
    limits = doors.door_limits(spark.createDataFrame([(0, -1.6, 2.6)], "scan_id int, floor_coord double, dz double"), vpm)
    walk = spark.createDataFrame([(0, k, 5.0, 20.0, -16.0 + k, 1.0, 0.0, 0.0) for k in range(1, 25)], "scan_id int, k int, px double, py double, pz double, ax double, ay double, az double")
    d = doors.depth_at(walk, vox, ["scan_id", "k"], 0.0, 0.0, vpm)
    first = doors.first_failing(d, ["scan_id"], "k", F.col("found") < 1e9).first()["first"]
    assert first == 20
    found = doors.find_doors(vox, axes, limits, vpm).collect()
    assert {(r["ci"], r["axis"]) for r in found} >= {(0, 0)}
    door = next(r for r in found if (r["ci"], r["axis"]) == (0, 0))
    assert (door["h"], door["w"]) == (2.0, 1.0) and door["corner"]["y"] == pytest.approx(1.9, abs=0.11)


def test_consensus_draws_few_of_many(spark):
    """Batches follow the seeded order without sorting the items, and end long before all are tried."""
    rows = [(g, i, float(g if i % 2 else i)) for g in range(3) for i in range((4000, 700, 2)[g])]
    items = spark.createDataFrame(rows, "scan_id int, cand long, b double")
    seen = []

    def score(batch):
        seen.extend((r["scan_id"], r["k"], r["cand"]) for r in batch.collect())
        per = items.select("scan_id", F.col("b").alias("v")).join(batch, "scan_id").where("v = b").groupBy("scan_id", "k", "cand")
        return per.agg(F.count("*").alias("support")).select("scan_id", "k", "support", F.struct("cand").alias("found"))

    total = items.groupBy("scan_id").agg(F.count("*").alias("total"))
    best = {r["scan_id"]: r for r in stats.until_settled(items, "cand", total, ["scan_id"], score, 7, first=16).collect()}
    hashed = lambda i: hashlib.md5(f"{i}:7".encode()).hexdigest()
    for g, n in enumerate((4000, 700, 2)):
        order = sorted(range(n), key=hashed)
        mine = sorted((k, c) for s, k, c in seen if s == g)
        assert [c for _, c in mine] == order[: len(mine)] and [k for k, _ in mine] == list(range(1, len(mine) + 1))
        assert len(mine) < 200
        assert best[g]["found"]["cand"] == next(c for c in order if c % 2 or (g, c) in ((0, 0), (2, 0), (2, 1)))


@pytest.mark.parametrize("turn", [0.0, 0.7])
def test_lines_find_what_probes_find(spark, turn):
    """Walks that share lines give the depths of separate probes, for axes along the voxels and turned ones."""
    rng = np.random.default_rng(3)
    vpm = 10.0
    vox = {tuple(int(x) for x in rng.integers([-25, -25, 0], [25, 25, 6])): float(i) for i in range(900)}
    vox = spark.createDataFrame([(0, *k, d) for k, d in vox.items()], "scan_id int, vx int, vy int, vz int, depth double")
    c, n = math.cos(turn), math.sin(turn)
    second, third = [c, n, 0.0], [-n, c, 0.0]
    axes = spark.createDataFrame([(0, [0.0, 0.0, 1.0], second, third)], "scan_id int, up_axis array<double>, second array<double>, third array<double>")
    assert axes.select(doors.on_lines(F.col("second"), F.col("third"))).first()[0]
    rows = [(i, int(i % 4), *map(int, rng.integers(-24, 24, 2)), float(rng.choice([1.3, -1.3, 0.0])), float(rng.integers(0, 5)) + 0.2, 0.0) for i in range(400)]
    probes = spark.createDataFrame([(0, *r) for r in rows], "scan_id int, idx int, axis int, ci int, cj int, along double, up double, floor double")
    got = {r["idx"]: r["found"] for r in doors.line_depths(probes, vox, axes, ["scan_id", "idx"], 0.8, vpm).collect()}
    plain = []
    for i, axis, ci, cj, along, up, _ in rows:
        a = np.array(third if axis % 2 else second) * (1 if axis < 2 else -1)
        p = np.array(second) * ci + np.array(third) * cj + a * along + [0, 0, up]
        plain.append((0, i, *map(float, p), *map(float, a)))
    plain = spark.createDataFrame(plain, "scan_id int, idx int, px double, py double, pz double, ax double, ay double, az double")
    want = {r["idx"]: r["found"] for r in doors.depth_at(plain, vox, ["scan_id", "idx"], 0.8, 0.0, vpm).collect()}
    assert got == want and 50 < sum(v < 1e9 for v in want.values()) < 400


def test_door_at_fifty_voxels_a_metre(spark):
    """The operator's own resolution: a doorway 0.9 m wide and 2 m high in a wall 2 m away."""
    x, z = (g.ravel() for g in np.meshgrid(np.arange(-70, 100), np.arange(-80, 50)))
    solid = ~((x >= 0) & (x < 45) & (z < 20))
    cells = [(0, int(i), 100, int(k), math.sqrt(i * i + 10_000 + k * k) / 50) for i, k in zip(x[solid], z[solid])]
    vox = spark.createDataFrame(cells + [(0, 0, 90, 0, 1.8)], "scan_id int, vx int, vy int, vz int, depth double")
    axes = spark.createDataFrame([(0, [0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "scan_id int, up array<double>, second array<double>, third array<double>")
    limits = doors.door_limits(spark.createDataFrame([(0, -1.6, 2.6)], "scan_id int, floor_coord double, dz double"))
    found = doors.find_doors(vox, axes, limits).collect()
    assert found and all(r["h"] == pytest.approx(2.0, abs=0.05) and r["w"] == pytest.approx(0.9, abs=0.07) for r in found)
    assert any(r["axis"] == 0 and abs(r["ci"]) <= 3 for r in found)


def test_merge_places_scans_side_by_side(spark):
    pts = spark.createDataFrame([(s, i, (i % 10) * 0.1, (i // 10) * 0.1, 0.0) for s in range(2) for i in range(100)], "scan_id int, idx long, x double, y double, z double")
    eye = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    poses = spark.createDataFrame([(0, [float(x) for x in eye], [0.0, 0.0, 0.0]), (1, [float(x) for x in eye], [2.0, 0.0, 0.0])], "scan_id int, rot array<double>, t array<double>")
    cloud, moves = merging.merge_scans(pts, poses, leaf=0.01, k=4, m=10.0)
    assert cloud.count() == 200 and moves.count() == 2
    assert cloud.agg(F.max("x")).first()[0] == pytest.approx(2.9)
    refined, after = merging.merge_scans(pts, poses, refine=True, leaf=0.01, k=4, m=10.0, rounds=1)
    assert refined.count() == 200 and after.count() == 2


def test_hot_tile_is_split_into_blocks(spark, monkeypatch):
    """All boxes in one tile: every pair once, and no block of the join holds many rows of a side."""
    rng = np.random.default_rng(2)
    lo = rng.integers(0, 60, (300, 3))
    hi = lo + rng.integers(-1, 25, (300, 3))
    box = lambda i: tuple(int(v) for a in range(3) for v in (lo[i, a], hi[i, a]))
    kind = "struct<x1: int, x2: int, y1: int, y2: int, z1: int, z2: int>"
    nodes = spark.createDataFrame([(i, i % 7, 0, box(i)) for i in range(300)], f"node_id int, scan_id int, rot int, box {kind}")
    full = [all(hi[i] >= lo[i]) for i in range(300)]
    want = {(i, j) for j in range(300) for i in range(j) if i % 7 != j % 7 and full[i] and full[j] and all(lo[i] <= hi[j]) and all(lo[j] <= hi[i])}
    assert {(r["a"], r["b"]) for r in graph.overlap_pairs(nodes).collect()} == want
    small = graph.overlap_pairs(nodes, tile=10**6, block=16)
    assert sorted((r["a"], r["b"]) for r in small.collect()) == sorted(want)
    side = nodes.select(F.lit(1).alias("t"), F.col("node_id").alias("a"))
    left, right = stages.blocks(side, side.withColumnRenamed("a", "b"), ["t"], "a", "b", 16)
    assert max(r["count"] for df in (left, right) for r in df.groupBy("t", "_p", "_q").count().collect()) < 50
    at = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((200, 2)) * 3)], "node_id int, x double, y double")
    xy = np.array([(r["x"], r["y"]) for r in at.orderBy("node_id").collect()])
    near = {(i, j) for i in range(200) for j in range(200) if i != j and math.dist(xy[i], xy[j]) < 1.5}
    assert {(r["a"], r["b"]) for r in neighbors.near_pairs(at, 1.0, block=8).collect()} == near


def test_pixels_seen_by_one_set_are_summed(spark):
    """Pairs of nodes that see the same pixels, against a sum over every pixel."""
    rng = np.random.default_rng(11)
    nodes = spark.createDataFrame([(i, i // 2, i % 2, 3 + i % 3, 4, 3, 3) for i in range(8)], "node_id int, scan_id int, rot int, x int, y int, zx int, zy int")
    free = spark.createDataFrame([(s, r, int(a), int(b)) for s in range(4) for r in range(2) for a, b in {tuple(map(int, q)) for q in rng.integers(0, 7, (25, 2))}], "scan_id int, rot int, row int, col int")
    wt = {}
    for r in graph.high_order_weights(nodes, free, 9, 9, 1.0).collect():
        wt.setdefault((r["row"], r["col"]), []).append((r["node_id"], r["scan_id"], r["wt"]))
    want = {}
    for seen in wt.values():
        for a, sa, wa in seen:
            for b, sb, wb in seen:
                if sa != sb:
                    want[a, b] = want.get((a, b), 0.0) - 0.5 * (wa + wb)
    out = graph.higher_order(nodes, free, 9, 9, 1.0)
    assert {(r["a"], r["b"]): r["h_weight"] for r in out.collect()} == pytest.approx(want)
    assert "collect_list" not in out._jdf.queryExecution().toString()


def _corner(rng, n, at):
    """Points on a floor and two walls that meet, around a place."""
    a = rng.random((n, 2)) * 2
    flat = np.c_[a, np.zeros(n)], np.c_[a[:, 0], np.zeros(n), a[:, 1]], np.c_[np.zeros(n), a]
    return np.concatenate(flat) + at


def test_waves_give_what_a_walk_in_order_gives(spark):
    """Two pairs of overlapping scans far apart: two waves, refining entered, cloud and transforms those of a fold."""
    rng = np.random.default_rng(12)
    places = [(0.0, 0, 0), (40.0, 40, 0), (0.0, 0, 0), (40.0, 40, 0)]
    rows = []
    for scan, at in enumerate(places):
        shift = [0.006, -0.004, 0.003] if scan > 1 else [0, 0, 0]
        rows += [(scan, i, *map(float, q)) for i, q in enumerate(_corner(np.random.default_rng(scan % 2), 250, np.array(at)) + rng.normal(0, 2e-4, (750, 3)) + shift)]
    pts = spark.createDataFrame(rows, "scan_id int, idx long, x double, y double, z double")
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    poses = spark.createDataFrame([(s, eye, [0.0, 0.0, 0.0]) for s in range(4)], "scan_id int, rot array<double>, t array<double>")
    before = merging.pose_transforms(poses)
    kept, boxes = (stages.cut(x, "t") for x in merging.prepare_scans(pts, before, 0.02))
    order = {r["scan_id"]: r["wave"] for r in merging.waves(merging.reach_of(kept, boxes)).collect()}
    assert order == {0: 0, 1: 0, 2: 1, 3: 1}
    cloud, after = merging.merge_scans(pts, poses, refine=True, leaf=0.02, k=5, m=10.0, rounds=2)
    merged, moves = None, {}
    for scan in range(4):
        mine = kept.where(F.col("scan_id") == scan)
        if merged is not None:
            target = stages.cut(neighbors.points_in_box(merged, boxes.where(F.col("scan_id") == scan), ["scan_id"]), "t")
            if target.count() > 0.25 * mine.count():
                sample = lambda df: merging.with_curvature(neighbors.uniform_sample(df, 0.04, ["scan_id"]), df)
                fit = neighbors.refine(sample(mine), sample(target), ["scan_id"], 2, features=["curvature"])
                moves[scan] = fit.first()["m"]
                mine = merging.merging.apply_transforms(mine, fit)
        tagged = mine.withColumn("idx", F.struct("scan_id", "idx")).drop("scan_id")
        merged = stages.cut(neighbors.uniform_sample(tagged if merged is None else merged.unionByName(tagged), 0.02, [], "idx"), "t")
    assert set(moves) == {2, 3}
    flat = lambda df: {(r["idx"]["scan_id"], r["idx"]["idx"]): (r["x"], r["y"], r["z"]) for r in df.collect()}
    got, want = flat(cloud), flat(neighbors.drop_statistical_outliers(merged, 5, 10.0))
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    mats = {r["scan_id"]: (np.array(r["before"]), np.array(r["after"])) for r in after.collect()}
    for scan in range(4):
        step = np.array(moves.get(scan, np.eye(4).ravel())).reshape(4, 4)
        assert np.allclose(step @ mats[scan][0].reshape(4, 4), mats[scan][1].reshape(4, 4))
    assert all(np.abs(np.array(moves[s]).reshape(4, 4)[:3, 3]).max() > 1e-4 for s in (2, 3))


def test_scale_search_finds_the_minimum(spark):
    calls = []

    def score_at(scales):
        calls.append(scales)
        return spark.createDataFrame([(float(s), abs(s - 11.3)) for s in scales], "scale double, score double")

    assert placing.find_scale(score_at, 10.0) == pytest.approx(11.3, abs=0.11)


def test_built_in_operators_use_no_python_and_no_cartesian_product(spark, sf_dir):
    import __spark_entry__ as entry

    for key in ("s1_point_evidence", "d12_pyramid", "d29_local_mean", "d31_erode", "f01_fill_gaps", "e01_e02_correlate", "f03_local_minima",
                "e08_covariance_radius", "e04_overlap_pairs", "e20_redact", "d28_ncc", "e07_rotate_grid_round", "d24_normalise_edges"):
        plan = entry.queries()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "BatchEvalPython", "MapInPandas"):
            assert word not in plan, (key, word)


def test_pose_matrix_inverts_and_flips(spark):
    a = 0.4
    rot = [math.cos(a), -math.sin(a), 0.1, math.sin(a), math.cos(a), 0.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(rot, [1.0, 2.0, 3.0])], "r array<double>, t array<double>")
    m = np.array(df.select(G.pose_matrix(F.col("r"), F.col("t")).alias("m")).first()["m"]).reshape(4, 4)
    flip = np.diag([1.0, -1.0, 1.0, 1.0])
    want = np.eye(4)
    want[:2, :2] = np.linalg.inv([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    want[:3, 3] = [1, 2, 3]
    assert np.allclose(m, flip @ want @ flip)


def test_combined_edges_are_directed(spark):
    nodes = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "node_id int, scan_id int")
    geo = spark.createDataFrame([(0, 1, 0.5, 0.9, 1.0), (0, 2, 0.2, 0.9, 1.0)], "a int, b int, w double, w_sig double, distance double")
    pano = spark.createDataFrame([(0, 1, 0.8, 0.9)], "a int, b int, pano_w double, pano_sig double")
    high = spark.createDataFrame([(0, 1, -0.1), (1, 0, -0.1)], "a int, b int, h_weight double")
    assert labelling.combine_edges(geo, pano, high, nodes).count() == 4
