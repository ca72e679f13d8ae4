"""Mixing sources to target weights by repetition.

Sizes are counted per document and added up per source. Sources in order of their names by code
point, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the total size by weight; a target stops
at ``most`` times its source's size, and what is left over is shared again by weight among the
others until none is above. A document is emitted floor(rate) times, where rate is its source's
target over its source's size, plus once more with probability equal to the fraction, decided by
a hash of the seed and the doc_id.

Defined results: a null text has size 0; documents without words are emitted like the others of
their source. A source without any words has target 0 and is not emitted. Rows that repeat a doc_id
are decided alike. A null doc_id is decided as an empty one. An empty table gives an empty mix.
Columns other than doc_id, source and text are kept by ``emitted``, whatever their names, and
otherwise ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrid.llm.arrow_text import unused
from pointgrid.stages import cut, ranked

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the doc_id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target of every source; ``sizes`` has source and size of every document."""
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    order = totals.withColumn("_null", F.col("source").isNull())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = cut(
        ranked(order, ["_null", "source"]).select(
            "source", "source_size", weight.cast("long").alias("weight"), (most * F.col("source_size")).alias("cap")
        ),
        "weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    # A source is full if its share by weight of what the full ones leave reaches its cap; shares only grow.
    left, weights = total, None
    while True:
        share = F.lit(left).cast("decimal(38,0)") * F.col("weight")
        open_ = F.lit(True) if weights is None else F.col("cap").cast("decimal(38,0)") * weights > share
        filled, still = weighed.agg(F.sum(F.when(~open_, F.col("cap"))), F.sum(F.when(open_, F.col("weight")))).first()
        if not still or (total - (filled or 0), still) == (left, weights):
            break
        left, weights = total - (filled or 0), still
    target = F.col("cap").cast("double")
    if weights:
        target = F.when(open_, (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(weights))).otherwise(target)
    return cut(weighed.select("source", "source_size", target.alias("target")), "targets")


def planned(docs: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken of every document."""
    sizes = cut(docs.select("doc_id", "source", size().alias("size")), "sizes")
    shares = targets(sizes, most).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    more = draw(seed) < F.col("rate") - F.floor("rate")
    return (
        sizes.join(shares, F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "size", "source_size", "target", rate.alias("rate"))
        .withColumn("copies", F.floor("rate") + more.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def emitted(docs: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    mix, rate, copies, copy = unused(docs.columns, "_source", "_rate", "_copies", "_copy")
    shares = targets(docs.select("source", size().alias("size")), most)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = shares.select(F.col("source").alias(mix), each.alias(rate))
    taken = F.floor(rate) + (draw(seed) < F.col(rate) - F.floor(rate)).cast("long")
    return (
        docs.join(shares, F.col("source").eqNullSafe(F.col(mix)))
        .withColumn(copies, taken)
        .where(F.col(copies) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
        .select(*docs.columns)
    )
