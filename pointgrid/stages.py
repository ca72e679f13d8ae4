"""Stage tables in the cluster's shared folder, and the few helpers built on them.

Lineage is cut by writing a Parquet stage and reading it back: the result survives
lost executors, and its true size is known to the planner for the next join.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_LOCAL_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a private one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="pointgrid-stages-")
    return _LOCAL_FALLBACK[app]


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table. Runs a job."""
    path = new_stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> DataFrame:
    """Store a per-group table (statistics, extents, frames) before it is joined to rows.

    The planner then knows its true size: below the broadcast threshold the large side
    is not shuffled at all, above it the join falls back to a shuffle with skew
    handling. An aggregate left in the plan would be guessed as large as its input and
    force that shuffle. Runs a job.
    """
    return cut(df, "measured")


def write_stage(df: DataFrame, root: str, name: str, keys: list[str] | None = None) -> None:
    """Store a stage table, partitioned by ``keys`` when given."""
    writer = df.write.mode("overwrite")
    if keys:
        writer = writer.partitionBy(*keys)
    writer.parquet(f"{root}/{name}")


def read_stage(spark: SparkSession, root: str, name: str, keys: DataFrame | None = None) -> DataFrame:
    """Read a stage table; ``keys`` restricts it to the listed key values (pruned at the scan)."""
    df = spark.read.parquet(f"{root}/{name}")
    return df if keys is None else df.join(keys, keys.columns, "left_semi")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Redistribute a compact input ahead of a step that multiplies its rows.

    The partition count is explicit, so adaptive execution keeps the parallelism
    that the small input size would otherwise hide.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def grown(df: DataFrame) -> DataFrame:
    """A side of a join whose rows were multiplied above a small table.

    The planner takes it for as small as that table and would send all of it through the driver; here
    both sides are shuffled and merged, and a hot key is split as in any other join.
    """
    return df.hint("merge")


def blocks(left: DataFrame, right: DataFrame, on: list[str], left_member: str, right_member: str, size: int = 8192,
           weights: tuple[Column, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``on, _p, _q`` in which the rows of a hot key are dealt over blocks.

    A key with n rows on one side has about n / size parts there, chosen by a hash of the member; a row is
    sent to the blocks of its part with every part of the other side. A block holds about ``size`` rows of
    either side, and each pair meets in exactly one. A row counts as many as ``weights`` says (left, right). Keys
    without rows on both sides are left out. Runs a job.
    """
    one = F.lit(1)
    count = lambda df, of, name: df.groupBy(*on).agg(F.ceil(F.sum(of) / size).cast("int").alias(name))
    loads = measured(count(left, (weights or (one, one))[0], "_m").join(count(right, (weights or (one, one))[1], "_n"), on))
    part = lambda member, of: F.pmod(F.xxhash64(member), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    lhs = left.join(loads, on).withColumn("_p", part(left_member, "_m")).withColumn("_q", every("_n"))
    rhs = right.join(loads, on).withColumn("_p", every("_m")).withColumn("_q", part(right_member, "_n"))
    return lhs.drop("_m", "_n"), rhs.drop("_m", "_n")


#: Rows in one bunch, and from how many on its pairs are listed in a stage of their own.
BUNCH, LONG = 512, 5


def bunched(df: DataFrame, by: list[str], member: str, size: int = BUNCH) -> DataFrame:
    """Rows equal in ``by`` as rows ``by, _bunch, _ids``: the array of about ``size`` of their members each, nulls left out.

    What holds for a pair of rows by their ``by`` alone is then found once per pair of bunches (``each_pair``).
    A group of any size only makes more bunches. Runs jobs.
    """
    key, row = F.xxhash64(*by), F.monotonically_increasing_id()
    # Kept with the number of the row, so that rows that repeat are dealt out as well.
    kept = cut(df.where(F.col(member).isNotNull()).select(*by, member, key.alias("_key"), row.alias("_row")), "bunches")
    loads = measured(kept.groupBy("_key").agg(F.ceil(F.count("*") / size).cast("int").alias("_of")).where("_of > 1"))
    part = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_of")).cast("int"), F.lit(0))
    dealt = kept.join(loads, "_key", "left").withColumn("_bunch", part)
    return dealt.groupBy(*by, "_bunch").agg(F.sort_array(F.collect_list(member)).alias("_ids"))


def longest(bunches: DataFrame) -> int:
    """Rows in the longest bunch of a stored table. Runs a job."""
    return bunches.agg(F.max(F.size("_ids"))).first()[0] or 0


def each_pair(pairs: DataFrame, left: str, right: str, a: str, b: str, most: int) -> DataFrame:
    """A row for every two members of the arrays ``left`` and ``right``, as ``a`` and ``b``.

    ``most`` is the length of the longest array. From ``LONG`` on a lambda ends the compiled stage: what is behind
    it takes a bunch at a time instead of all that one row of the join meets, which would be held in memory.
    """
    rest = [c for c in pairs.columns if c not in (left, right)]
    one = pairs.select(*rest, F.explode(F.transform(left, lambda x: x) if most >= LONG else F.col(left)).alias(a), right)
    return one.select(*rest, a, F.explode(right).alias(b))


def ranked(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Exact 1-based rank over ``order`` (inside ``by``) without gathering a group.

    Rows are range partitioned and stored sorted; a row's rank is its position in
    its partition plus the sizes of the partitions before it. No task ever sees
    more than one range partition, however large a group is. Runs a job.
    """
    by = by or []
    keys = [F.col(c) for c in by + order]
    placed = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "rank",
    ).withColumn("_part", F.shiftright("_mid", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = measured(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_off")))
    out = placed.join(offsets, "_part").withColumn(
        name, F.col("_off") + F.col("_mid").bitwiseAND((1 << 33) - 1) + 1
    )
    if by:
        first = measured(out.groupBy(*by).agg(F.min(name).alias("_first")))
        out = out.join(first, by).withColumn(name, F.col(name) - F.col("_first") + 1)
    return out.select(*df.columns, name)


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Half-up rounding by ``floor``, with halves nudged up so that last-bit noise in a
    sum cannot flip them; both engines evaluate it identically."""
    c = F.col(c) if isinstance(c, str) else c
    m = 10**digits
    return F.floor(c * F.lit(float(m)) + 0.500001) / m


def rounded_sql(expr: str, digits: int = 4) -> str:
    m = 10**digits
    return f"floor(({expr}) * {m}.0 + 0.500001) / {m}"
