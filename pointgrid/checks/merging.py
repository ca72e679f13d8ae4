"""Merging (K06, K07)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import merging as ops
from ..operators import neighbors
from ..plans import merging
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check

PTS = ["scan_id", "idx", "x", "y", "z"]


def transforms_of(v):
    """One turn and shift per scan."""
    s = v.scanpts.select("scan_id").distinct()
    a, z, o = F.col("scan_id") * 0.2, F.lit(0.0), F.lit(1.0)
    return s.select("scan_id", F.array(F.cos(a), -F.sin(a), z, F.col("scan_id") * 0.5, F.sin(a), F.cos(a), z, -F.col("scan_id") * 0.25, z, z, o, z, z, z, z, o).alias("m"))


MOVED = """mv AS (SELECT scan_id, idx, cos(scan_id * 0.2) * x - sin(scan_id * 0.2) * y + scan_id * 0.5 AS x, sin(scan_id * 0.2) * x + cos(scan_id * 0.2) * y - scan_id * 0.25 AS y, z FROM v_scanpts)"""


@check("k07_apply_transforms", S(f"WITH {MOVED} SELECT scan_id, idx, {s4('x')} AS x, {s4('y')} AS y, {s4('z')} AS z FROM mv", "v_scanpts"))
def _k07a(v):
    p = ops.apply_transforms(v.scanpts.select(*PTS), transforms_of(v))
    return p.select("scan_id", "idx", *[r4(c).alias(c) for c in "xyz"])


def _off(a, leaf=0.25):
    return f"({a} - (floor({a} / {leaf}) + 0.5) * {leaf})"


@check("k07_merge_sample", S(
    f"""WITH {MOVED} SELECT scan_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 0.25), floor(y / 0.25), floor(z / 0.25)
    ORDER BY {' + '.join(f'{_off(a)} * {_off(a)}' for a in 'xyz')}, scan_id, idx) rk FROM mv) WHERE rk = 1""", "v_scanpts"))
def _k07s(v):
    p = ops.apply_transforms(v.scanpts.select(*PTS), transforms_of(v)).withColumn("idx", F.struct("scan_id", "idx"))
    return neighbors.uniform_sample(p, 0.25, [], "idx").select("idx.scan_id", "idx.idx")


@check("k07_merge_with_transforms", S(
    f"""WITH {MOVED}, th AS MATERIALIZED (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 0.05), floor(y / 0.05), floor(z / 0.05)
      ORDER BY {' + '.join(f'{_off(a, 0.05)} * {_off(a, 0.05)}' for a in 'xyz')}, scan_id, idx) rk FROM mv) WHERE rk = 1),
    nn AS (SELECT q.scan_id, q.idx, q.x, q.y, q.z, min((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z), 51) AS d FROM th q, th p GROUP BY ALL),
    md AS (SELECT *, list_sum(list_transform(d, lambda v: sqrt(v))) / (len(d) - 1) AS md FROM nn WHERE len(d) > 1),
    lm AS (SELECT avg(md) + 2.0 * stddev_samp(md) AS lim FROM md)
    SELECT scan_id, idx, {s4('x')} AS x, {s4('y')} AS y, {s4('z')} AS z FROM md, lm WHERE md <= lim""", "v_scanpts"))
def _k07(v):
    m = merging.merge_with_transforms(v.scanpts.select(*PTS), transforms_of(v), leaf=0.05)
    return m.select("idx.scan_id", "idx.idx", *[r4(c).alias(c) for c in "xyz"])


@check("k06_merge_scans")
def _k06(v):
    a, z, o = F.col("scan_id") * (math.pi / 8), F.lit(0.0), F.lit(1.0)
    poses = v.scanpts.select("scan_id").distinct().select(
        "scan_id", F.when(F.col("scan_id") % 4 != 3, F.array(F.cos(a), -F.sin(a), z, F.sin(a), F.cos(a), z, z, z, o)).alias("rot"),
        F.array(F.col("scan_id") * 1.0, F.col("scan_id") * 0.5, z).alias("t"))
    cloud, _ = merging.merge_scans(v.scanpts.select(*PTS), poses, leaf=0.05, k=8)
    return cloud.select("idx.scan_id", "idx.idx", "x", "y", "z")
