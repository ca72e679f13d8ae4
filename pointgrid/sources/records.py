"""Placement files, transforms, redaction rectangles and the scale file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed values of the record formats.
PLACEMENT_HEADER = ("Score", "x", "y", "rotation")
BEFORE, AFTER = "Before general icp:", "After general icp:"
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def best_placements(df: DataFrame, zero_zero: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` best placements per scan, moved to the scanner's pixel."""
    w = W.partitionBy("scan_id").orderBy("score", "rot", "x", "y")
    best = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    return best.join(zero_zero, ["scan_id", "rot"]).select(
        "scan_id", "rank", "score", (F.col("x") + F.col("zx")).alias("x"), (F.col("y") + F.col("zy")).alias("y"), "rot")


def save_placements(df: DataFrame, zero_zero: DataFrame, path: str, cap: int) -> None:
    """Space separated text per scan, best first, with the header line."""
    names = dict(zip(("score", "x", "y", "rot"), PLACEMENT_HEADER))
    best_placements(df, zero_zero, cap).repartition("scan_id").sortWithinPartitions("scan_id", "rank").select(
        "scan_id", *[F.col(c).alias(n) for c, n in names.items()]).write.partitionBy("scan_id").option(
        "sep", " ").option("header", True).csv(path)


def load_placements(spark: SparkSession, path: str, cap: int) -> DataFrame:
    df = spark.read.option("sep", " ").option("header", True).schema(
        "Score double, x int, y int, rotation int, scan_id int").csv(path)
    df = df.select("scan_id", F.col("Score").alias("score"), F.col("x"), F.col("y"), F.col("rotation").alias("rot"))
    w = W.partitionBy("scan_id").orderBy("score", "rot", "x", "y")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def load_true_placements(spark: SparkSession, path: str, zero_zero: DataFrame) -> DataFrame:
    """``scan_id, x, y, rot`` of every placement on file, moved back from the scanner's pixel to the template's corner."""
    df = spark.read.option("sep", " ").option("header", True).schema(
        "Score double, x int, y int, rotation int, scan_id int").csv(path)
    return df.withColumnRenamed("rotation", "rot").join(zero_zero, ["scan_id", "rot"]).select(
        "scan_id", (F.col("x") - F.col("zx")).alias("x"), (F.col("y") - F.col("zy")).alias("y"), "rot")


def _text4(m: Column) -> Column:
    rows = [F.concat_ws(" ", *[m[4 * i + j].cast("string") for j in range(4)]) for i in range(4)]
    return F.concat_ws("\n", *rows)


def write_transforms(df: DataFrame, path: str) -> None:
    """One text per scan from ``(scan_id, before, after)`` matrices."""
    text = F.concat(F.lit(BEFORE + "\n"), _text4(F.col("before")), F.lit("\n\n" + AFTER + "\n"), _text4(F.col("after")), F.lit("\n"))
    df.select("scan_id", text.alias("value")).repartition("scan_id").write.partitionBy("scan_id").text(path)


def read_transforms(spark: SparkSession, path: str, stage: str = "after") -> DataFrame:
    """``scan_id, m`` of one stage from transform texts (32 numbers per file)."""
    df = spark.read.text(path, wholetext=True)
    numbers = F.transform(F.regexp_extract_all("value", F.lit(f"({NUMBER})"), 1), lambda v: v.cast("double"))
    first = 1 if stage == "before" else 17
    return df.select("scan_id", F.slice(numbers, first, 16).alias("m"))


def write_combined_transforms(df: DataFrame, path: str, per_file: int = 10_000) -> None:
    """All scans' matrices as one text in scan order, each under its scan's number (parts follow one another)."""
    text = F.concat(F.col("scan_id").cast("string"), F.lit("\n\n" + BEFORE + "\n"), _text4(F.col("before")), F.lit("\n\n" + AFTER + "\n"), _text4(F.col("after")), F.lit("\n\n"))
    rows = df.repartitionByRange("scan_id").sortWithinPartitions("scan_id")
    rows.select(text.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def read_combined_transforms(spark: SparkSession, path: str, stage: str = "after") -> DataFrame:
    """``scan_id, m`` of one stage from a combined text: a number and 32 matrix entries per scan."""
    parts = spark.read.text(path, wholetext=True)
    each = parts.select(F.explode(F.split("value", rf"(?m)^(?=-?\d+\s+{BEFORE})")).alias("value"))
    numbers = F.regexp_extract_all("value", F.lit(f"({NUMBER})"), 1)
    first = 2 if stage == "before" else 18
    return each.select(numbers.alias("n")).where(F.size("n") == 33).select(
        F.col("n")[0].cast("int").alias("scan_id"), F.transform(F.slice("n", first, 16), lambda v: v.cast("double")).alias("m"))


def rects_from_json(df: DataFrame, col: str) -> DataFrame:
    """Rectangles of annotation bodies: ``floor_id, img_name, pos, x, y, width, height``."""
    schema = ("rects array<struct<x:double,y:double,width:double,height:double>>, "
              "img_data struct<floor_id:string,img_name:string>")
    j = df.select(F.from_json(col, schema).alias("j"))
    return j.select("j.img_data.floor_id", "j.img_data.img_name", F.posexplode("j.rects").alias("pos", "_r")).select(
        "floor_id", "img_name", "pos", "_r.*")


def write_rects(rects: DataFrame, path: str) -> None:
    rects.select("scan_id", "x", "y", "width", "height").write.partitionBy("scan_id").option("sep", " ").csv(path)


def read_rects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", " ").schema(
        "x double, y double, width double, height double, scan_id int").csv(path)


def scale(spark: SparkSession, path: str, override: float = -1.0) -> DataFrame:
    """One-row table with the plan scale; the file counts only when no override is given."""
    given = F.when(F.lit(override) != -1.0, F.lit(float(override)))
    return spark.read.text(path).where(F.trim("value") != "").agg(
        F.coalesce(given, F.max(F.trim("value").cast("double"))).alias("scale"))
