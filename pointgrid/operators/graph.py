"""Candidate graph: pairs, edge weights, labels and final poses.

``nodes`` is ``(node_id, scan_id, rot, x, y, w, nw)``; ``edges`` is directed,
``(a, b, ...)`` with a the row node and b the column node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions.weights import clamp, clamped_norm, gaussian_weight, node_weight
from ..stages import BUNCH, blocks, bunched, cut, each_pair, grown, longest, measured, ranked, spread

# Fixed values of the labelling model.
UNARY_WEIGHT, NO_LABEL_UNARY, NO_LABEL_PAIR = 0.75, -1.0, -10.0
NO_LABEL_AGREEMENT = -1000.0
GEO_CENTRE, PANO_CENTRE = (0.1, 0.6), (0.3, 0.7)
HIGH_ORDER_RANGE, HIGH_ORDER_SIGMA = 1.5, 5.0
UNLOCK_BELOW = -0.75
NODES_PER_SCAN = 5
# A message that moves less than this is at rest; rounds without a better labelling before a start is given up.
SETTLED, PATIENCE = 1e-3, 8


def top_per(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows of each group; the engine trims every task's rows before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_fraction(df: DataFrame, by: list[str], order: list[str], f: float = 0.7) -> DataFrame:
    """First trunc(f n) + 1 rows of each group, by distributed rank. Runs a job."""
    r = ranked(df, order, by)
    size = df.groupBy(*by).agg(F.count("*").alias("_n"))
    return r.join(measured(size), by).where(F.col("rank") <= (F.col("_n") * f).cast("long") + 1).select(*df.columns)


def normalise_nodes(placements: DataFrame) -> DataFrame:
    """Adds ``w = 1 - score`` and its z-score within the scan."""
    p = placements.withColumn("w", node_weight(F.col("score")))
    s = p.groupBy("scan_id").agg(F.avg("w").alias("_m"), F.stddev_samp("w").alias("_s"))
    return p.join(measured(s), "scan_id").withColumn("nw", (F.col("w") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def select_nodes(placements: DataFrame, order: list[str], n: int = NODES_PER_SCAN) -> DataFrame:
    """Best ``n`` placements per scan with dense ids in (scan, rank) order. Runs a job."""
    best = top_per(placements, ["scan_id"], [F.col(c) for c in order], n)
    ids = ranked(best.select("scan_id", "rank"), ["scan_id", "rank"], name="node_id")
    return best.join(ids, ["scan_id", "rank"]).withColumn("node_id", (F.col("node_id") - 1).cast("int")).drop("rank")


def candidates_per_scan(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("scan_id").agg(F.count("*").alias("n_candidates"))


def overlap_pairs(nodes: DataFrame, tile: int = 64, block: int = 8192) -> DataFrame:
    """Pairs a < b of different scans whose boxes meet, with the overlap relative to each.

    ``nodes`` carries ``box``. Nodes of a scan with one box are compared as a bunch. Boxes are laid out as cubic map
    tiles and joined on the tile; a pair is reported only by the tile holding the lower corner of its overlap, so
    nothing has to be deduplicated. A tile with many nodes is split into blocks of about ``block`` nodes a side. Runs jobs.
    """
    real = nodes.where(F.col("scan_id").isNotNull())
    for c in "xyz":
        real = real.where(F.col(f"box.{c}1") <= F.col(f"box.{c}2"))
    laid = cut(bunched(real, ["scan_id", "rot", "box"], "node_id", min(BUNCH, block)), "boxes")
    most = longest(laid)
    laid = laid.withColumn("_own", F.struct("scan_id", "rot", "box", "_bunch"))
    for c in "xyz":
        laid = laid.withColumn(f"t{c}", F.explode(F.sequence(F.floor(F.col(f"box.{c}1") / tile), F.floor(F.col(f"box.{c}2") / tile))))
    tiles = ["tx", "ty", "tz"]
    side = lambda s: laid.select(*tiles, *[F.col(c).alias(f"{n}_{s}") for c, n in (
        ("_own", "own"), ("scan_id", "scan_id"), ("rot", "rot"), ("box", "full"), ("_ids", "ids"))])
    left, right = blocks(side("a"), side("b"), tiles, "own_a", "own_b", block, (F.size("ids_a"), F.size("ids_b")))
    on = [*tiles, "_p", "_q"]
    p = spread(left.drop("own_a"), *on).join(grown(spread(right.drop("own_b"), *on)), on).where(F.col("scan_id_a") != F.col("scan_id_b"))
    p = p.where(G.boxes_meet(F.col("full_a"), F.col("full_b")))
    for c in "xyz":
        p = p.where(F.floor(F.greatest(f"full_a.{c}1", f"full_b.{c}1") / tile) == F.col(f"t{c}"))
    p = p.withColumn("cross", G.box_intersect(F.col("full_a"), F.col("full_b"))).select(
        "ids_a", "ids_b", F.col("scan_id_a").alias("scan_a"), F.col("rot_a"), F.col("scan_id_b").alias("scan_b"), F.col("rot_b"),
        G.box_relative(F.col("cross"), F.col("full_a")).alias("box_a"),
        G.box_relative(F.col("cross"), F.col("full_b")).alias("box_b"),
        G.box_volume(F.col("cross")).alias("volume"))
    return each_pair(p, "ids_a", "ids_b", "a", "b", most).where(F.col("a") < F.col("b")).select(
        "a", "b", "scan_a", "rot_a", "scan_b", "rot_b", "box_a", "box_b", "volume")


def mirror(edges: DataFrame, swap: dict[str, str] | None = None) -> DataFrame:
    """Both directions of every edge; ``swap`` lists further columns that trade places."""
    pairs = {"a": "b", "b": "a", **(swap or {})}
    # Both from one row, so that what makes the edges runs once; a flag, as an array of two rows is built anew for every edge.
    way = edges.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("_back"))
    return way.select(*[F.when(F.col("_back"), F.col(pairs[c])).otherwise(F.col(c)).alias(c) if c in pairs else F.col(c) for c in edges.columns])


def high_order_weights(nodes: DataFrame, free: DataFrame, rows: int, cols: int, scale: float) -> DataFrame:
    """Weight of every plan pixel a node sees: a Gaussian around the scanner that sums
    to a constant over the node's in-plan pixels."""
    p = nodes.join(free.select("scan_id", "rot", "row", "col"), ["scan_id", "rot"]).select(
        "node_id", "scan_id", (F.col("row") - F.col("zy")).alias("dy"), (F.col("col") - F.col("zx")).alias("dx"), "x", "y")
    p = p.select("node_id", "scan_id", (F.col("dy") + F.col("y")).alias("row"), (F.col("dx") + F.col("x")).alias("col"),
                 gaussian_weight(F.col("dx") / scale, F.col("dy") / scale, HIGH_ORDER_SIGMA, HIGH_ORDER_SIGMA).alias("g"))
    p = p.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    total = p.groupBy("node_id").agg(F.sum("g").alias("_t"))
    return p.join(measured(total), "node_id").select("node_id", "scan_id", "row", "col", (F.col("g") * HIGH_ORDER_RANGE / F.col("_t")).alias("wt"))


def higher_order(nodes: DataFrame, free: DataFrame, rows: int, cols: int, scale: float) -> DataFrame:
    """Penalty ``(a, b, h_weight)`` for nodes of different scans that see the same pixels.

    Pixels seen by the same set of nodes are summed first, so node pairs are formed
    once per distinct set instead of once per pixel; the sum is linear and unchanged.
    """
    w = cut(high_order_weights(nodes, free, rows, cols, scale), "pixels")
    # A set is known by its size and two combinable hashes of its nodes, never listed for a pixel.
    wide = F.xxhash64("node_id", F.lit(17)).cast("decimal(20,0)")
    seen = w.groupBy("row", "col").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("node_id")).alias("_x"), F.sum(wide).alias("_s"))
    seen = seen.where("_n > 1").select("row", "col", F.struct("_n", "_x", "_s").alias("key"))
    sets = cut(w.join(seen, ["row", "col"]).groupBy("key", "node_id", "scan_id").agg(F.sum("wt").alias("wt")), "sets")
    side = lambda s: sets.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node_id", "scan_id", "wt")])
    pairs = side("a").join(side("b"), "key").where(F.col("scan_id_a") != F.col("scan_id_b"))
    return pairs.groupBy(F.col("node_id_a").alias("a"), F.col("node_id_b").alias("b")).agg(
        (F.sum(F.col("wt_a") + F.col("wt_b")) * -0.5).alias("h_weight"))


def normalise_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Centre and scale ``w`` and ``pano_w`` by the statistics of the row node's scan.

    Zero weights mean "no edge" and stay zero; a scan with fewer than two weights keeps them. Edges that
    carry the row node's scan as ``scan_a`` are not joined with ``nodes``.
    """
    scan = nodes.select(F.col("node_id").alias("a"), F.col("scan_id").alias("_scan"))
    e = edges.withColumn("_scan", F.col("scan_a")) if "scan_a" in edges.columns else edges.join(scan, "a")
    real = lambda c: F.when(F.col(c) != 0, F.col(c))
    s = e.groupBy("_scan").agg(
        *[f for c in ("w", "pano_w") for f in (F.avg(real(c)).alias(f"m_{c}"), F.stddev_samp(real(c)).alias(f"s_{c}"))])
    e = e.join(measured(s), "_scan")

    def norm(c: str, centre: tuple[float, float]) -> Column:
        ok = (F.col(c) != 0) & (F.col(f"s_{c}") > 0)
        return F.when(ok, clamped_norm(F.col(c), clamp(F.col(f"m_{c}"), *centre), F.col(f"s_{c}"))).otherwise(F.col(c))

    done = e.withColumns({"w": norm("w", GEO_CENTRE), "pano_w": norm("pano_w", PANO_CENTRE)})
    return done.select(*edges.columns)


def label_graph(nodes: DataFrame, edges: DataFrame, patience: int = PATIENCE, damping: float = 0.5) -> DataFrame:
    """One node (or none) per scan, maximising node weights plus pair weights.

    Max-sum message passing on the graph of linked scans: ``edges`` is ``(a, b, weight)``
    with a in the later and b in the earlier scan. A scan without a label scores -1, and
    every pair of scans with one or two such ends scores -10. Pairs without a link depend
    only on which scans have a label: their part of the score of "no label" follows from the
    labelling before, and two starts are tried, all scans labelled and none. Each round is a
    join and a grouped maximum; the round whose decoded labelling has the highest value is
    returned. A start ends when no message moves by more than ``SETTLED`` and the same scans have no label, or, where messages run in
    circles, after ``patience`` rounds on end without a better labelling. Runs jobs.
    Returns ``scan_id, node_id`` (NULL for no label).
    """
    own = nodes.select("scan_id", "node_id", F.coalesce(F.nanvl(F.col("nw"), F.lit(0.0)) * UNARY_WEIGHT, F.lit(0.0)).alias("u"))
    scans = nodes.select("scan_id").distinct()
    where = nodes.select("node_id", "scan_id")
    e = cut(edges.join(where.select(F.col("node_id").alias("a"), F.col("scan_id").alias("i")), "a").join(
        where.select(F.col("node_id").alias("b"), F.col("scan_id").alias("j")), "b").where("i <> j").select(
        "i", "a", "j", "b", "weight"), "labels")
    both = e.unionByName(e.select(F.col("j").alias("i"), F.col("b").alias("a"), F.col("i").alias("j"), F.col("a").alias("b"), "weight"))
    links = both.select("i", "j").distinct()
    degree = links.groupBy(F.col("i").alias("scan_id")).agg(F.count("*").alias("deg"))
    n_scans = scans.count()
    none = scans.join(degree, "scan_id", "left").select(
        "scan_id", F.lit(-1).alias("node_id"), F.lit(NO_LABEL_UNARY).alias("u"), (n_scans - 1 - F.coalesce("deg", F.lit(0))).alias("apart"))
    labels = cut(own.withColumn("apart", F.lit(0).cast("long")).unionByName(none), "labels")
    lab = lambda s, n: labels.select(F.col("scan_id").alias(s), F.col("node_id").alias(n))
    free = (F.col("a") >= 0) & (F.col("b") >= 0)
    factors = cut(links.join(lab("i", "a"), "i").join(lab("j", "b"), "j").join(both, ["i", "a", "j", "b"], "left").select(
        "i", "a", "j", "b", F.when(free, F.coalesce("weight", F.lit(0.0))).otherwise(F.lit(NO_LABEL_PAIR)).alias("theta")), "labels")
    start = cut(factors.select("i", "j", "b").distinct().withColumn("m", F.lit(0.0)), "labels")
    best, best_value = None, None
    of_bare = F.count("*"), F.bit_xor(F.xxhash64("scan_id"))
    for first in (scans.where("false"), scans):
        msg, bare, idle, own_value = start, cut(first, "labels"), 0, None
        mark = bare.agg(*of_bare).first()
        while True:
            # Scans without a label that have no link to this one: their pairs cost no more if it has none either.
            linked = links.join(bare.select(F.col("scan_id").alias("j")), "j", "left_semi").groupBy(F.col("i").alias("scan_id")).agg(F.count("*").alias("_near"))
            spared = bare.withColumn("_self", F.lit(1)).join(linked, "scan_id", "full_outer")
            into = msg.groupBy(F.col("j").alias("scan_id"), F.col("b").alias("node_id")).agg(F.sum("m").alias("_in"))
            costly = F.col("apart") - (mark[0] - F.coalesce("_near", F.lit(0)) - F.coalesce("_self", F.lit(0)))
            belief = labels.join(spared, "scan_id", "left").join(into, ["scan_id", "node_id"], "left").select(
                "scan_id", "node_id", "u", "apart",
                (F.col("u") + F.when(F.col("node_id") < 0, costly * NO_LABEL_PAIR).otherwise(0.0) + F.coalesce("_in", F.lit(0.0))).alias("belief"))
            belief = cut(belief, "labels")
            pick = cut(belief.groupBy("scan_id").agg(F.max_by(F.struct("node_id", "u", "apart"), F.struct("belief", "node_id")).alias("p"))
                       .select("scan_id", "p.node_id", "p.u", "p.apart"), "labels")
            value = labelling_value(pick, factors)
            if best_value is None or value > best_value + 1e-12:
                best, best_value = pick, value
            idle = 0 if own_value is None or value > own_value + 1e-12 else idle + 1
            own_value = value if idle == 0 else own_value
            if idle >= patience:
                break
            bare, before = pick.where("node_id < 0").select("scan_id"), mark
            mark = bare.agg(*of_bare).first()
            back = msg.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("b").alias("a"), F.col("m").alias("_back"))
            send = factors.join(belief.select(F.col("scan_id").alias("i"), F.col("node_id").alias("a"), "belief"), ["i", "a"])
            send = send.join(back, ["i", "j", "a"], "left").groupBy("i", "j", "b").agg(
                F.max(F.col("belief") - F.coalesce("_back", F.lit(0.0)) + F.col("theta")).alias("m"))
            top = send.groupBy("i", "j").agg(F.max("m").alias("_top"))
            send = send.join(top, ["i", "j"]).select("i", "j", "b", (F.col("m") - F.col("_top")).alias("_new"))
            moved = F.abs(F.col("_new") - F.col("m")).alias("_moved")
            msg = cut(msg.join(send, ["i", "j", "b"]).select(
                "i", "j", "b", (F.col("m") * damping + F.col("_new") * (1.0 - damping)).alias("m"), moved), "labels")
            if mark == before and (msg.agg(F.max("_moved")).first()[0] or 0.0) <= SETTLED:
                break
            msg = msg.drop("_moved")
    return best.select("scan_id", F.when(F.col("node_id") >= 0, F.col("node_id")).alias("node_id"))


def labelling_value(pick: DataFrame, factors: DataFrame) -> float:
    """Total of a labelling: node terms, each linked pair once, and each pair without a link that lacks a label.

    ``pick`` has ``scan_id, node_id, u`` and, for a scan without a label (node -1), ``apart``: how many
    scans it has no link to.
    """
    side = lambda s, n: pick.select(F.col("scan_id").alias(s), F.col("node_id").alias(n))
    pair = cut(factors.where("i < j").join(side("i", "a"), ["i", "a"], "left_semi").join(side("j", "b"), ["j", "b"], "left_semi"), "labels")
    own, apart, bare = pick.agg(F.coalesce(F.sum("u"), F.lit(0.0)), F.coalesce(F.sum("apart"), F.lit(0)), F.count_if(F.col("node_id") < 0)).first()
    linked, both = pair.agg(F.coalesce(F.sum("theta"), F.lit(0.0)), F.count_if((F.col("a") < 0) & (F.col("b") < 0))).first()
    return own + linked + NO_LABEL_PAIR * (apart - (bare * (bare - 1) // 2 - both))


def agreement(solution: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean non-zero edge weight of each chosen node to the other chosen nodes.

    ``edges`` is ``(a, b, weight)``, a the row node. Scans without a label get -1000 and
    are unlocked.
    """
    chosen = solution.where(F.col("node_id").isNotNull()).select("node_id")
    e = edges.where(F.col("weight") != 0).join(chosen.select(F.col("node_id").alias("a")), "a", "left_semi")
    mean = e.groupBy(F.col("b").alias("node_id")).agg(F.avg("weight").alias("_mean"))
    has = F.col("node_id").isNotNull()
    return solution.join(mean, "node_id", "left").select(
        *[solution[c] for c in solution.columns],
        F.when(has, F.coalesce("_mean", F.lit(0.0))).otherwise(F.lit(NO_LABEL_AGREEMENT)).alias("agreement"),
        has.alias("locked"))


def unlock_weak(solution: DataFrame, z: float = UNLOCK_BELOW) -> DataFrame:
    """Unlock scans whose agreement is far below that of the locked ones; adds ``norm``."""
    contested = F.col("n_candidates") > 1
    v = F.when(F.col("locked") & contested, F.col("agreement"))
    st = solution.agg(F.struct(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).alias("st")).scalar()
    norm = F.when(contested, (F.col("agreement") - st["m"]) / F.nullif(st["s"], F.lit(0.0)))
    return solution.withColumn("norm", norm).withColumn(
        "locked", F.col("locked") & ~F.coalesce(F.col("norm") < z, F.lit(False)))


def exclude_near(solution: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of two neighbouring locked nodes the one with the lower agreement is unlocked, pair by pair.

    ``pairs`` is the symmetric ``(a, b)`` list of nodes too close together. Pairs count in
    the order of their lower, then their higher node; a pair counts only if both of its nodes
    are still locked, and on a tie the higher node is unlocked. Each round decides every pair
    that no undecided earlier pair touches. Runs jobs.
    """
    cols = solution.columns
    locked = solution.where("locked").select("node_id", "agreement")
    side = lambda s, n: locked.select(F.col("node_id").alias(s), F.col("agreement").alias(n))
    live = cut(pairs.where("a < b").select("a", "b").distinct().join(side("a", "ga"), "a").join(side("b", "gb"), "b"), "near")
    lost = None
    while not live.isEmpty():  # the first pair is always ready, so every round decides one
        ends = live.select(F.col("a").alias("n"), "a", "b").unionByName(live.select(F.col("b").alias("n"), "a", "b"))
        first = measured(ends.groupBy("n").agg(F.min(F.struct("a", "b")).alias("p")))
        of = lambda s: first.select(F.col("n").alias(s), F.col("p").alias(f"p{s}"))
        own = F.struct("a", "b")
        ready = live.join(of("a"), "a").join(of("b"), "b").where((F.col("pa") == own) & (F.col("pb") == own))
        out = cut(ready.select(F.when(F.col("ga") < F.col("gb"), F.col("a")).otherwise(F.col("b")).alias("node_id")), "near")
        lost = out if lost is None else lost.unionByName(out)
        gone = lambda s: out.select(F.col("node_id").alias(s))
        live = cut(live.join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti"), "near")
    if lost is None:
        return solution
    lost = lost.withColumn("_lost", F.lit(True))
    return solution.join(lost, "node_id", "left").withColumn(
        "locked", F.col("locked") & F.col("_lost").isNull()).select(*cols)


def exclude_within(solution: DataFrame, by: list[str]) -> DataFrame:
    """``exclude_near`` where all nodes with equal ``by`` are too close together, without the list of their pairs.

    Walking those pairs in order leaves of a group's locked nodes the one with the highest agreement, the
    lowest node on a tie; a first node without an agreement is never unlocked.
    """
    g, n = F.col("agreement"), F.col("node_id")
    locked = solution.where("locked").dropna(subset=by)
    top = locked.groupBy(*by).agg(F.min_by(F.struct(n, g.isNull().alias("bare")), n).alias("f"), F.max_by(n, F.struct(g, -n)).alias("t"))
    best = top.select(*by, F.when(F.col("f.bare"), F.col("f.node_id")).otherwise(F.col("t")).alias("_best"))
    out = solution.join(best, by, "left")
    return out.withColumn("locked", F.col("locked") & (F.col("_best").isNull() | (F.col("_best") == n))).select(*solution.columns)


def second_round(nodes: DataFrame, solution: DataFrame) -> DataFrame:
    """Chosen nodes of locked scans, every candidate of the others."""
    locked = solution.where("locked")
    cols = nodes.columns
    fixed = nodes.join(locked.select("node_id"), "node_id", "left_semi").withColumn("locked", F.lit(True))
    rest = nodes.join(locked.select("scan_id"), "scan_id", "left_anti").withColumn("locked", F.lit(False))
    return fixed.select(*cols, "locked").unionByName(rest.select(*cols, "locked"))


def with_attributes(nodes: DataFrame, *tables: DataFrame) -> DataFrame:
    """Per-rotation attributes (metadata, rotation, origin) of each node."""
    for t in tables:
        nodes = nodes.join(t, ["scan_id", "rot"])
    return nodes


def final_poses(solution: DataFrame, rotations: DataFrame, pano_meta: DataFrame, scale: float) -> DataFrame:
    """Rotation and translation in metres per scan, relative to the first scan's node.

    ``solution`` has ``scan_id, rot, x, y, labelled``. Scans without a label get a NULL
    rotation.
    """
    s = solution.join(pano_meta.select("scan_id", "floor_coord"), "scan_id").select(
        "scan_id", "rot", "labelled", (F.col("x") / scale).alias("tx"), (F.col("y") / scale).alias("ty"), F.col("floor_coord").alias("tz"))
    c = s.agg(F.min_by(F.struct("tx", "ty", "tz"), "scan_id").alias("c")).scalar()
    t = F.array(*[F.col(f"t{a}") - c[f"t{a}"] for a in "xyz"])
    return s.join(rotations, ["scan_id", "rot"], "left").select(
        "scan_id", F.when(F.col("labelled"), F.col("m")).alias("rot"), t.alias("t"))
