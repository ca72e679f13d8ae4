"""Members of one index key compared in blocks of bounded size, so that a hot key is split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrid.stages import cut


def dealt(members: DataFrame, keys: list[str], member: str, size: int = 1024, weight: str = "1", heavy: int | None = None) -> DataFrame:
    """Copies of ``members`` for the blocks that compare them; keys with one member are left out.

    A key with n members has about n / size parts by a hash of ``member``; every two parts meet
    in one block (_i, _j), and members of one part also in (_i, _i). A block has about 2 * size
    rows at most, and with ``heavy`` a ``weight`` of about 2 * heavy. The result is partitioned by
    block and sorted by it.
    """
    loads = members.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.expr(weight)).alias("_w")).where("_n > 1")
    counts = cut(loads.withColumn("_n", F.greatest(F.col("_n") / size, F.col("_w") / heavy) if heavy else F.col("_n") / size).drop("_w"), "loads")
    parts = F.ceil("_n").cast("int")
    own = F.pmod(F.xxhash64(member), F.col("_parts")).cast("int")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = [*keys, "_i", "_j"]
    return (
        members.join(counts, keys)
        .withColumn("_parts", parts)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("_i", F.least("_own", "_other"))
        .withColumn("_j", F.greatest("_own", "_other"))
        .drop("_n", "_parts", "_other")
        .repartition(n, *block)
        .sortWithinPartitions(*block)
    )


def runs(batches: Iterator[pa.RecordBatch], block: list[str]) -> Iterator[pa.Table]:
    """The rows of each block, from batches sorted by block."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        ids = [t.column(c).to_numpy() for c in block]
        change = np.zeros(t.num_rows, bool)
        for x in ids:
            change[1:] |= x[1:] != x[:-1]
        starts = [0, *np.flatnonzero(change), t.num_rows]
        for a, z in zip(starts, starts[1:], strict=False):
            key = tuple(x[a] for x in ids)
            if key != last and held:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(t.slice(a, z - a))
    if held:
        yield pa.concat_tables(held)


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric matrix of links."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new
