"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrid.stages import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root for every end of ``links`` (u long, v long); root is the smallest node reachable.

    Large and small stars in turn until nothing changes. Every step is a minimum per node and
    a join of two stored tables, so a node with very many links is combined before the shuffle
    and its join can be split. Links of a node to itself keep the node. Null ends are dropped.
    """
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).dropna()
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    known = _state(edges)
    while known[0]:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = cut(both.join(least, "u").where("v > u OR v = m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = cut(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        state = _state(edges)
        if state == known:
            break
        known = state
    # All edges now lead from a node to its root.
    return edges.union(edges.select("v", "v")).toDF("node", "root").groupBy("node").agg(F.min("root").alias("root"))
