"""Statistics, consensus and dominant directions (D, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import stats
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check


@check("d01_mean_stdev", S(
    f"SELECT scan_id, {s4('avg(CASE WHEN intensity > 0.2 THEN x END)')} AS mean, {s4('stddev_samp(CASE WHEN intensity > 0.2 THEN x END)')} AS sigma "
    "FROM v_points GROUP BY scan_id", "v_points"))
def _d01(v):
    s = stats.mean_stdev(v.points, ["scan_id"], F.col("x"), F.col("intensity") > 0.2)
    return s.select("scan_id", r4("mean").alias("mean"), r4("sigma").alias("sigma"))


@check("d02_box_stats", S("SELECT scan_id, " + ", ".join(
    f"{s4(f'avg({a})')} AS mean_{a}, {s4(f'stddev_samp({a})')} AS sigma_{a}" for a in "xyz") + " FROM v_points GROUP BY scan_id", "v_points"))
def _d02(v):
    s = stats.box_stats(v.points, ["scan_id"])
    return s.select("scan_id", *[r4(c).alias(c) for c in s.columns if c != "scan_id"])


def dominant_sql(src: str, tol="0.03") -> str:
    """Dominant value of ``src(scan_id, v, n)`` as ``(scan_id, centre, support, dominant)``."""
    return f"""(SELECT scan_id, centre, support, dominant FROM (
      SELECT a.scan_id, a.v AS centre, sum(b.n) AS support, sum(b.n * b.v) / sum(b.n) AS dominant,
             row_number() OVER (PARTITION BY a.scan_id ORDER BY sum(b.n) DESC, a.v) AS rk
      FROM {src} a JOIN {src} b ON a.scan_id = b.scan_id AND b.v > a.v - {tol} AND b.v < a.v + {tol} GROUP BY a.scan_id, a.v) WHERE rk = 1)"""


COUNTS = "c0 AS (SELECT scan_id, z AS v, count(*) AS n FROM v_scanpts GROUP BY scan_id, z)"


@check("d16_dominant_value", S(
    f"WITH {COUNTS} SELECT scan_id, centre, CAST(support AS BIGINT) AS support, {s4('dominant')} AS dominant FROM {dominant_sql('c0')}", "v_scanpts"))
def _d16(v):
    d = stats.dominant_value(v.scanpts, ["scan_id"], "z")
    return d.select("scan_id", "centre", "support", r4("dominant").alias("dominant"))


#: More rounds than the data need; the operator itself has no such number.
PEELS = 12


def _peel(cap: int, until: float) -> str:
    ctes = [COUNTS]
    for k in range(1, cap + 1):
        src = f"c{k - 1}"
        ctes.append(f"b{k} AS MATERIALIZED (SELECT scan_id, {k} AS round, dominant FROM {dominant_sql(src)})")
        found = " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, k + 1))
        ctes.append(f"f{k} AS (SELECT scan_id, min(dominant) lo, count(*) k FROM ({found}) GROUP BY scan_id)")
        ctes.append(f"c{k} AS MATERIALIZED (SELECT c.* FROM {src} c JOIN b{k} b USING (scan_id) JOIN f{k} f USING (scan_id) "
                    f"WHERE NOT (f.lo < {until} AND f.k >= 2) AND abs(c.v - b.dominant) >= 0.05)")
    return "WITH " + ", ".join(ctes) + f" SELECT scan_id, round, {s4('dominant')} AS dominant FROM (" + " UNION ALL ".join(
        f"SELECT * FROM b{i}" for i in range(1, cap + 1)) + ")"


@check("d17_peel_values", S(_peel(PEELS, -0.5), "v_scanpts"))
def _d17(v):
    p = stats.peel_values(v.scanpts, ["scan_id"], "z", until=-0.5)
    return p.select("scan_id", "round", r4("dominant").alias("dominant"))


@check("d17_floor_and_span", S(
    _peel(PEELS, -0.5).replace(f"SELECT scan_id, round, {s4('dominant')} AS dominant FROM (",
                           f"SELECT scan_id, {s4('least(min(dominant), 0)')} AS floor_coord, {s4('greatest(max(dominant), 0) - least(min(dominant), 0)')} AS dz FROM (")
    + " GROUP BY scan_id", "v_scanpts"))
def _d17b(v):
    p = stats.floor_and_span(stats.peel_values(v.scanpts, ["scan_id"], "z", until=-0.5), ["scan_id"])
    return p.select("scan_id", r4("floor_coord").alias("floor_coord"), r4("dz").alias("dz"))


def hyp_sql(src: str, name: str = "hy", seed: int = 7) -> str:
    """Every normal as a hypothesis ``h`` with its place ``k`` in the seeded order and the number of normals."""
    return (f"{name} AS (SELECT scan_id, idx h, nx hx, ny hy, nz hz, count(*) OVER (PARTITION BY scan_id) AS total, row_number() OVER ("
            f"PARTITION BY scan_id ORDER BY md5(CAST(idx AS VARCHAR) || ':{seed}'), idx) k FROM {src})")


def winner_sql(src: str) -> str:
    """First hypothesis with the greatest support among those tried before the best sufficed; ``src`` has k, support, total."""
    return (f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY support DESC, k) AS place FROM (
      SELECT *, max(support) OVER (PARTITION BY scan_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM {src})
      WHERE prior IS NULL OR k - 1 < ln(1.0 - 0.999) / ln(1.0 - greatest(0.001, pow((prior - 3.0) / total, 3)))) WHERE place = 1)""")


CL = "acos(greatest(least(abs({}), 1.0), -1.0))"
NH = "(n.nx*h.hx + n.ny*h.hy + n.nz*h.hz)"
D18 = (hyp_sql("v_normals") + f""", p1 AS (SELECT n.scan_id, h.h, h.k, h.total, n.nx, n.ny, n.nz, CASE WHEN {NH} < 0 THEN -1.0 ELSE 1.0 END sg
    FROM v_normals n JOIN hy h USING (scan_id) WHERE {CL.format(NH)} < 0.02),
 g1 AS (SELECT scan_id, h, k, total, count(*) support, sum(nx*sg) sx, sum(ny*sg) sy, sum(nz*sg) sz FROM p1 GROUP BY ALL),
 m1 AS (SELECT scan_id, h, support, sx / support mx, sy / support my, sz / support mz FROM """ + winner_sql("g1") + ")")


@check("d18_dominant_direction", S(
    f"WITH {D18} SELECT scan_id, h, support, {s4('mx')} AS mx, {s4('my')} AS my, {s4('mz')} AS mz FROM m1", "v_normals"))
def _d18(v):
    d = stats.dominant_direction(v.normals)
    return d.select("scan_id", "h", "support", *[r4(f"m{a}").alias(f"m{a}") for a in "xyz"])


@check("d19_dominant_pair", S(
    f"""WITH {D18}, sd AS (SELECT n.*, mx ax, my ay, mz az FROM v_normals n JOIN m1 USING (scan_id)
      WHERE asin(greatest(least(sqrt((ny*mz-nz*my)**2 + (nz*mx-nx*mz)**2 + (nx*my-ny*mx)**2), 1.0), -1.0)) > pi() / 2 - 0.02),
    {hyp_sql('sd', 'h2')},
    q AS (SELECT n.*, h.h, h.k, h.total, hx, hy, hz, {CL.format(NH)} d1,
       {CL.format('n.nx*(hy*az-hz*ay) + n.ny*(hz*ax-hx*az) + n.nz*(hx*ay-hy*ax)')} d2 FROM sd n JOIN h2 h USING (scan_id)),
    x AS (SELECT *, CASE WHEN d1 < 0.02 THEN nx ELSE ny*az-nz*ay END vx, CASE WHEN d1 < 0.02 THEN ny ELSE nz*ax-nx*az END vy,
       CASE WHEN d1 < 0.02 THEN nz ELSE nx*ay-ny*ax END vz FROM q WHERE least(d1, d2) < 0.02),
    g AS (SELECT scan_id, h, k, total, count(*) support, sum(vx*sg) sx, sum(vy*sg) sy, sum(vz*sg) sz FROM (
       SELECT *, CASE WHEN vx*hx+vy*hy+vz*hz < 0 THEN -1.0 ELSE 1.0 END sg FROM x) GROUP BY ALL),
    w AS (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) ln FROM {winner_sql('g')})
    SELECT scan_id, h, support, {s4('sx/ln')} AS mx, {s4('sy/ln')} AS my, {s4('sz/ln')} AS mz FROM w""", "v_normals"))
def _d19(v):
    first = stats.dominant_direction(v.normals)
    d = stats.dominant_pair(v.normals, first)
    return d.select("scan_id", "h", "support", *[r4(f"m{a}").alias(f"m{a}") for a in "xyz"])


@check("j02_consensus", S(
    f"""WITH c AS (SELECT scan_id, cand_id cand, score b, count(*) OVER (PARTITION BY scan_id) AS total,
      row_number() OVER (PARTITION BY scan_id ORDER BY md5(CAST(cand_id AS VARCHAR) || ':7'), cand_id) k FROM v_place),
    g AS (SELECT p.scan_id, cand, k, total, count(*) support, avg(score) estimate FROM v_place p JOIN c USING (scan_id) WHERE abs(score - b) < 0.02 GROUP BY ALL)
    SELECT scan_id, cand, support, {s4('estimate')} AS estimate FROM {winner_sql('g')}""", "v_place"))
def _j02(v):
    c = v.place.select("scan_id", F.col("cand_id").alias("cand"), F.col("score").alias("b"))
    out = stats.consensus(v.place.select("scan_id", "score"), c, ["scan_id"], F.abs(F.col("score") - F.col("b")) < 0.02, F.avg("score"))
    return out.withColumn("estimate", r4("estimate"))


@check("s2_scan_frame")
def _frame(v):
    """Four rotations per scan from its normals: dominant direction, pair, order, turns."""
    one = stats.dominant_direction(v.normals)
    two = stats.dominant_pair(v.normals, one)
    p = two.select("scan_id", *[F.col(f"m{a}").alias(f"s{a}") for a in "xyz"], *[f"p{a}" for a in "xyz"]).join(
        one.select("scan_id", *[f"m{a}" for a in "xyz"]), "scan_id")
    rots = G.four_rotations(*G.order_axes(G.vec("m"), G.vec("s"), G.vec("p")))
    return p.select("scan_id", F.posexplode(rots).alias("rot", "m"))
