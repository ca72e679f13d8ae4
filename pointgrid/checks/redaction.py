"""Redaction."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import redact
from ..stages import rounded as r4
from ..stages import rounded_sql as s4
from ..views import with_views as S
from . import check


def image_of(v):
    g = F.coalesce("value", F.lit(0.0))
    return v.grid.select("scan_id", "row", "col", (g * 255).alias("r"), (F.lit(255.0) - g * 255).alias("g"), (F.col("row") + F.col("col")).cast("double").alias("b"))


SIGMA2 = 2.0 * (4.0 * math.e) ** 2
IMAGE = 'im AS (SELECT scan_id, "row", col, coalesce(value, 0) * 255 AS r, 255.0 - coalesce(value, 0) * 255 AS g, CAST("row" + col AS DOUBLE) AS b FROM v_grid)'
BLUR = f"""{IMAGE}, rp AS (SELECT rect_id, scan_id, CAST(trunc(x * 100) AS INT) x0, CAST(trunc(y * 100) AS INT) y0, CAST(trunc(width * 100) AS INT) w, CAST(trunc(height * 100) AS INT) h FROM v_rects),
 px AS (SELECT *, CAST(trunc(13 + (w // 2 - abs(c - (x0 + w // 2))) / 6.0) AS INT) | 1 AS kx, CAST(trunc(13 + (h // 2 - abs(r - (y0 + h // 2))) / 6.0) AS INT) | 1 AS ky FROM
   (SELECT *, unnest(generate_series(x0, x0 + w - 1)) AS c FROM (SELECT *, unnest(generate_series(y0, y0 + h - 1)) AS r FROM rp)) WHERE r < 100 AND c < 100),
 tp AS (SELECT rect_id, scan_id, r, c, CASE WHEN r + j < 0 OR r + j >= 100 THEN r - j ELSE r + j END AS sr, CASE WHEN c + i < 0 OR c + i >= 100 THEN c - i ELSE c + i END AS sc
   FROM (SELECT *, unnest(generate_series(-(kx // 2), kx // 2 - 1)) AS i FROM (SELECT *, unnest(generate_series(-(ky // 2), ky // 2 - 1)) AS j FROM px))),
 bl AS (SELECT rect_id, t.scan_id, t.r, t.c, sum(im.r * w) / sum(w) AS br, sum(im.g * w) / sum(w) AS bg, sum(im.b * w) / sum(w) AS bb FROM
   (SELECT *, exp(-((sc - c) * (sc - c) + (sr - r) * (sr - r)) / {SIGMA2!r}) AS w FROM tp) t JOIN im ON im.scan_id = t.scan_id AND im."row" = sr AND im.col = sc GROUP BY ALL),
 rd AS (SELECT scan_id, r AS "row", c AS col, arg_max(br, rect_id) AS r, arg_max(bg, rect_id) AS g, arg_max(bb, rect_id) AS b FROM bl GROUP BY scan_id, bl.r, bl.c)"""


@check("e20_redact", S(f'WITH {BLUR} SELECT scan_id, "row", col, {s4("r")} AS r, {s4("g")} AS g, {s4("b")} AS b FROM rd', "v_grid", "v_rects"))
def _e20(v):
    d = redact.redact(image_of(v), v.rects, 100, 100, ["r", "g", "b"])
    return d.withColumns({c: r4(c) for c in "rgb"})


BYTE = "CAST(least(greatest(round_even({}, 0), 0), 255) AS INT)"


@check("e20_write_back", S(
    f"""WITH {BLUR}, p AS (SELECT event_id % 10000 AS idx, CAST(floor(event_id / 10000) AS INT) AS scan_id, CAST(event_id % 7 AS INT) AS old FROM events),
    q AS (SELECT idx, scan_id, old, 99 - idx % 100 AS rr, 99 - ((49 - idx // 100) % 100 + 100) % 100 AS cc FROM p)
    SELECT q.scan_id, idx, CASE WHEN rd.r IS NULL THEN old ELSE {BYTE.format('rd.r')} END AS r, CASE WHEN rd.g IS NULL THEN old ELSE {BYTE.format('rd.g')} END AS g FROM q LEFT JOIN rd ON rd.scan_id = q.scan_id AND rd."row" = rr AND rd.col = cc""", "v_grid", "v_rects"))
def _e20b(v):
    e = F.col("event_id")
    old = (e % 7).cast("short")
    pts = v.table("events").select((e % 10000).alias("idx"), F.floor(e / 10000).cast("int").alias("scan_id"), *[old.alias(c) for c in "rgb"])
    d = redact.redact(image_of(v), v.rects, 100, 100, ["r", "g", "b"])
    return redact.write_back(pts, d, 100, 100).select("scan_id", "idx", "r", "g")
