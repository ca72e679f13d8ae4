"""Which scans to process: ranges, and what is still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import ranked


def select_scans(scans: DataFrame, start: int | None = None, count: int | None = None,
                 number: int | None = None, stop: int | None = None) -> DataFrame:
    """Scans by ordinal (``start``, ``count``) or from scan ``number`` on.

    ``scans`` has ``scan_id``; ordinals are 0-based in scan order. ``stop`` is an exclusive
    last ordinal. Runs a job.
    """
    r = ranked(scans.select("scan_id").distinct(), ["scan_id"], name="ordinal").withColumn("ordinal", F.col("ordinal") - 1)
    if number is not None:
        first = r.where(F.col("scan_id") >= number).agg(F.min("ordinal")).scalar()
    else:
        first = F.lit(start or 0)
    r = r.where(F.col("ordinal") >= first)
    if count is not None:
        r = r.where(F.col("ordinal") < first + count)
    if stop is not None:
        r = r.where(F.col("ordinal") < stop)
    return r


def pending(work: DataFrame, manifest: DataFrame, n_outputs: int, redo: bool = False) -> DataFrame:
    """Scans whose outputs do not all exist. ``manifest`` lists ``(scan_id, output)``."""
    if redo:
        return work
    done = manifest.groupBy("scan_id").agg(F.countDistinct("output").alias("n")).where(F.col("n") >= n_outputs)
    return work.join(done, "scan_id", "left_anti")
