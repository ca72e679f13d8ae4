"""Score reports and input consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import measured, ranked

MIN_DELTA = 0.0001


def score_deltas(placements: DataFrame, order: list[str]) -> DataFrame:
    """Score, change from the previous score and from the scan's first, in file order.

    Ranks are distributed and the previous row is found by an equi-join on the rank, so
    a scan of any size stays spread out; the first scores are one stored row per scan. Runs jobs.
    """
    r = ranked(placements, order, ["scan_id"])
    prev = r.select("scan_id", (F.col("rank") + 1).alias("rank"), F.col("score").alias("prev"))
    first = r.where("rank = 1").select("scan_id", F.col("score").alias("first"))
    return r.join(prev, ["scan_id", "rank"], "left").join(measured(first), "scan_id").select(
        "scan_id", "rank", "score", (F.col("score") - F.col("prev")).alias("delta"),
        F.when(F.col("rank") > 1, F.col("score") - F.col("first")).alias("total_delta"))


def score_report(placements: DataFrame, order: list[str]) -> DataFrame:
    """Minimum, maximum, mean and deviation of scores, deltas and total deltas."""
    d = score_deltas(placements, order)
    kept = F.when(F.col("delta") > MIN_DELTA, F.col("delta"))
    m = d.select(F.explode(F.array(
        F.struct(F.lit("score").alias("measure"), F.col("score").alias("v")),
        F.struct(F.lit("delta").alias("measure"), kept.alias("v")),
        F.struct(F.lit("total_delta").alias("measure"), F.col("total_delta").alias("v")))).alias("e")).select("e.*")
    return m.where(F.col("v").isNotNull()).groupBy("measure").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sigma"))


def check_inputs(**lists: DataFrame) -> DataFrame:
    """Scans missing from any of the named scan lists: one row per scan, one flag per list."""
    parts = [df.select("scan_id").distinct().select("scan_id", *[
        F.lit(1 if other == name else 0).alias(other) for other in lists]) for name, df in lists.items()]
    seen = reduce(DataFrame.unionByName, parts).groupBy("scan_id").agg(*[F.max(n).alias(n) for n in lists])
    missing = reduce(lambda a, b: a | b, [F.col(n) == 0 for n in lists])
    return seen.where(missing)
