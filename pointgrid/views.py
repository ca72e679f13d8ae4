"""Scan-shaped views over the driver's tables.

The text is the same for Spark and DuckDB except for list access in ``v_normals``.
Each view covers its whole base table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_BASE = {
    "v_points": ("lineitem", """
SELECT CAST(l_suppkey % 8 AS INT) AS scan_id, l_quantity / 5 - 5 AS x,
       (l_extendedprice - 50000) / 10000 AS y, l_discount * 30 - 1.5 AS z,
       l_tax * 12.5 AS intensity, CAST(l_partkey % 256 AS INT) AS r,
       CAST(l_suppkey % 256 AS INT) AS g, CAST(l_orderkey % 256 AS INT) AS b
FROM {lineitem}"""),
    "v_scanpts": ("events", """
SELECT event_id AS idx, CAST(user_id % 8 AS INT) AS scan_id,
       CAST(event_id % 101 AS DOUBLE) / 25 - 2 AS x,
       CAST((event_id * 7) % 97 AS DOUBLE) / 25 - 2 AS y,
       CAST(CAST(round(value * 100) AS BIGINT) % 300 AS DOUBLE) / 100 - 1.5 AS z,
       CAST(event_id % 50 AS DOUBLE) / 50 AS intensity
FROM {events}"""),
    "v_normals": ("embeddings", """
SELECT idx, scan_id, a / sqrt(a*a+b*b+c*c) AS nx, b / sqrt(a*a+b*b+c*c) AS ny, c / sqrt(a*a+b*b+c*c) AS nz
FROM (SELECT idx, scan_id,
             CASE idx % 4 WHEN 1 THEN 1 + 0.01 * a WHEN 3 THEN a ELSE 0.01 * a END AS a,
             CASE idx % 4 WHEN 2 THEN 1 + 0.01 * b WHEN 3 THEN b ELSE 0.01 * b END AS b,
             CASE idx % 4 WHEN 0 THEN 1 + 0.01 * c WHEN 3 THEN c ELSE 0.01 * c END AS c
      FROM (SELECT vec_id AS idx, CAST(label % 4 AS INT) AS scan_id,
                   CAST(<e0> AS DOUBLE) a, CAST(<e1> AS DOUBLE) b, CAST(<e2> AS DOUBLE) c
            FROM {embeddings}) e) p"""),
    "v_grid": ("events", """
SELECT CAST(floor(event_id / 10000) AS INT) AS scan_id,
       CAST(floor((event_id % 10000) / 100) AS INT) AS <row>,
       CAST(event_id % 100 AS INT) AS col,
       CASE WHEN event_type = 'error' THEN NULL ELSE least(value / 200, 1.0) END AS value
FROM {events}"""),
    "v_place": ("orders", """
SELECT o_orderkey AS cand_id, CAST(o_custkey % 10 AS INT) AS scan_id,
       CAST(o_orderkey % 4 AS INT) AS rot, CAST((o_orderkey * 13) % 200 AS INT) AS x,
       CAST((o_orderkey * 29) % 150 AS INT) AS y, floor(o_totalprice * 2 + 0.500001) / 1000000 AS score
FROM {orders}"""),
    "v_rects": ("supplier", """
SELECT CAST(s_suppkey AS INT) AS rect_id, CAST(s_suppkey % 8 AS INT) AS scan_id,
       CAST((s_suppkey * 7) % 80 AS DOUBLE) / 100 AS x, CAST((s_suppkey * 11) % 80 AS DOUBLE) / 100 AS y,
       CAST(s_suppkey % 10 + 5 AS DOUBLE) / 100 AS width, CAST(s_suppkey % 7 + 5 AS DOUBLE) / 100 AS height
FROM {supplier}"""),
    "v_doors": ("part", """
SELECT p_partkey AS door_id, CAST(p_partkey % 8 AS INT) AS scan_id,
       1.6 + CAST(p_size AS DOUBLE) / 50 AS h, 0.4 + CAST(p_partkey % 21 AS DOUBLE) / 10 AS w
FROM {part}"""),
    "v_desc": ("embeddings", "SELECT vec_id, label, embedding FROM {embeddings}"),
}


def spark_text(name: str) -> str:
    text = _BASE[name][1].replace("<row>", "`row`")
    for i in range(3):
        text = text.replace(f"<e{i}>", f"get(embedding, {i})")
    return text


def duckdb_text(name: str) -> str:
    table, text = _BASE[name]
    text = text.replace("<row>", '"row"').replace("{" + table + "}", table)
    for i in range(3):
        text = text.replace(f"<e{i}>", f"embedding[{i + 1}]")
    return text


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """Prefix ``body`` (which may start with further CTEs) with the named views."""
    ctes = ",\n".join(f"{n} AS ({duckdb_text(n)})" for n in names)
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body[:5].upper() == "WITH ":
        return f"{head}{ctes},\n{body[5:]}"
    return f"{head}{ctes}\n{body}"


class Views:
    """The check views of one table folder as DataFrames, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        table = _BASE[name][0]
        return self.spark.sql(spark_text(name), **{table: self.table(table)})

    @cached_property
    def points(self) -> DataFrame:
        return self._view("v_points")

    @cached_property
    def scanpts(self) -> DataFrame:
        return self._view("v_scanpts")

    @cached_property
    def normals(self) -> DataFrame:
        return self._view("v_normals")

    @cached_property
    def grid(self) -> DataFrame:
        return self._view("v_grid")

    @cached_property
    def place(self) -> DataFrame:
        return self._view("v_place")

    @cached_property
    def rects(self) -> DataFrame:
        return self._view("v_rects")

    @cached_property
    def doors(self) -> DataFrame:
        return self._view("v_doors")

    @cached_property
    def desc(self) -> DataFrame:
        return self._view("v_desc")
