"""Raw scan files.

Text scans are read as splittable text: line order is rebuilt from the position of
each split, so one very large file is still read by many tasks. Binary scans are cut
into byte ranges first, and each range is decoded on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..stages import measured

# Fixed values of the file formats.
HEADER_LINES = 10
BINARY_HEADER, BINARY_RECORD = 8, 19
SCAN_NAME = r"([A-Za-z]{3})_.*?_(\d{3})\.[a-z]{3}"
SHORT_NAME = r"([A-Za-z]{3})(\d{3})\.[a-z]{3}"

POINT_SCHEMA = "file string, idx long, x float, y float, z float, intensity float, r short, g short, b short"
RANGE_RECORDS = 1_000_000
#: Points of small ranges that are decoded together.
FRAME_RECORDS = 50_000


def list_files(spark: SparkSession, path: str, predicate: Column | None = None) -> DataFrame:
    """Files below ``path``: ``path, name, length``. Contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    df = df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return df if predicate is None else df.where(predicate)


def with_scan_name(df: DataFrame, file_col: str) -> DataFrame:
    """Adds ``building`` and ``scan`` parsed from a file name, NULL when it has neither form."""
    def part(i: int) -> Column:
        long = F.regexp_extract(file_col, SCAN_NAME, i)
        short = F.regexp_extract(file_col, SHORT_NAME, i)
        return F.nullif(F.when(long != "", long).otherwise(short), F.lit(""))

    return df.withColumn("building", part(1)).withColumn("scan", part(2))


def fixed_name(df: DataFrame, file_col: str) -> DataFrame:
    """The positional form: first three characters, and three before the first dot."""
    dot = F.instr(file_col, ".")
    return df.withColumn("building", F.substring(F.col(file_col), 1, 3)).withColumn(
        "scan", F.substr(F.col(file_col), dot - 3, F.lit(3)))


def text_lines(spark: SparkSession, path: str, per_folder: bool = False) -> DataFrame:
    """``file, line, value`` with 0-based line numbers.

    A file's splits are counted and each split's first line number is the sum of the
    splits before it; the text itself is never shuffled. Runs a job. With ``per_folder`` the part files of a folder form one file, in
    name order.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"))
    owner = F.regexp_extract("part", r"^(.*)/[^/]*$", 1) if per_folder else F.col("part")
    raw = raw.withColumn("file", owner)
    blocks = raw.groupBy("file", "part", "block").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    w = W.partitionBy("file").orderBy("part", "block").rowsBetween(W.unboundedPreceding, -1)
    start = blocks.select("part", "block", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    return raw.join(measured(start), ["part", "block"]).select(
        "file", (F.col("mid") - F.col("first") + F.col("start")).alias("line"), "value")


def ptx_source(spark: SparkSession, path: str, per_folder: bool = False) -> DataFrame:
    """Points of text scans: ``file, idx, x, y, z, intensity, r, g, b`` with colours clipped to bytes."""
    lines = text_lines(spark, path, per_folder)
    body = lines.where(F.col("line") >= HEADER_LINES).where(F.trim("value") != "")
    t = F.split(F.trim("value"), r"\s+")
    byte = lambda i: F.least(F.greatest(t[i].cast("double"), F.lit(0.0)), F.lit(255.0)).cast("short")
    pts = body.select(
        "file", (F.col("line") - HEADER_LINES).alias("idx"), *[t[i].cast("float").alias(n) for i, n in enumerate(
            ("x", "y", "z", "intensity"))], *[byte(4 + i).alias(n) for i, n in enumerate("rgb")])
    shape = ptx_headers(lines)
    return pts.join(measured(shape), "file").where(F.col("idx") < F.col("columns") * F.col("rows")).select(*pts.columns)


def ptx_headers(lines: DataFrame) -> DataFrame:
    """``file, columns, rows`` from the first two lines."""
    at = lambda i: F.max(F.when(F.col("line") == i, F.trim("value").cast("long")))
    return lines.where("line < 2").groupBy("file").agg(at(0).alias("columns"), at(1).alias("rows"))


def header_lines(shapes: DataFrame) -> DataFrame:
    """Ten header lines per scan: size, scanner pose, identity transform."""
    fixed = ["0 0 0", "1 0 0", "0 1 0", "0 0 1", "1 0 0 0", "0 1 0 0", "0 0 1 0", "0 0 0 1"]
    lines = F.array(F.col("columns").cast("string"), F.col("rows").cast("string"), *[F.lit(v) for v in fixed])
    return shapes.select("scan_id", F.posexplode(lines).alias("line", "value"))


def write_ptx(points: DataFrame, headers: DataFrame, path: str) -> None:
    """One folder per scan whose part files, in name order, form the scan file.

    Rows are range partitioned by scan and position, so a large scan is written by
    several tasks. ``headers`` is ``(scan_id, line, value)``.
    """
    body = F.format_string("%f %f %f %f %d %d %d", *[F.col(c).cast("double") for c in ("x", "y", "z", "intensity")],
                           *[F.col(c).cast("int") for c in "rgb"])
    rows = points.select("scan_id", (F.col("idx") + HEADER_LINES).cast("long").alias("line"), body.alias("value"))
    every = headers.select("scan_id", F.col("line").cast("long").alias("line"), "value").unionByName(rows)
    every.repartitionByRange("scan_id", "line").sortWithinPartitions("scan_id", "line").select(
        "scan_id", "value").write.partitionBy("scan_id").text(path)


def binary_ranges(spark: SparkSession, path: str, records: int = RANGE_RECORDS) -> DataFrame:
    """Byte ranges of binary scans, at most ``records`` points each."""
    files = list_files(spark, path).where(F.col("length") > BINARY_HEADER)
    n = F.floor((F.col("length") - BINARY_HEADER) / BINARY_RECORD)
    return files.withColumn("n", n).where("n > 0").withColumn(
        "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(records).cast("long")))).select(
        F.col("path").alias("file"), "start", F.least(F.lit(records), F.col("n") - F.col("start")).alias("count"))


def _decode(frames):
    import numpy as np
    import pandas as pd
    from pyarrow import fs

    record = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])

    def points(file, firsts, raw):
        data = np.frombuffer(b"".join(raw), dtype=record)
        out = pd.DataFrame({n: data[n] for n in record.names})
        out[["r", "g", "b"]] = out[["r", "g", "b"]].astype("int16")
        out.insert(0, "idx", np.concatenate([np.arange(first, first + len(part) // record.itemsize, dtype="int64") for first, part in zip(firsts, raw)]))
        out.insert(0, "file", file)
        return out

    # Ranges come sorted, so a file is opened once and its small ranges go on in one frame.
    for frame in frames:
        for file, ranges in frame.groupby("file", sort=False):
            place, name = fs.FileSystem.from_uri(file)
            firsts, raw, held = [], [], 0
            with place.open_input_file(name) as f:
                for start, count in zip(ranges["start"], ranges["count"]):
                    f.seek(BINARY_HEADER + int(start) * BINARY_RECORD)
                    firsts.append(int(start))
                    raw.append(f.read(int(count) * BINARY_RECORD))
                    held += int(count)
                    if held >= FRAME_RECORDS:
                        yield points(file, firsts, raw)
                        firsts, raw, held = [], [], 0
            if raw:
                yield points(file, firsts, raw)


def binary_point_source(spark: SparkSession, path: str, records: int = RANGE_RECORDS) -> DataFrame:
    """Points of binary scans, decoded range by range from shared storage."""
    ranges = binary_ranges(spark, path, records)
    return ranges.repartition("file", "start").sortWithinPartitions("file", "start").mapInPandas(_decode, POINT_SCHEMA)


def write_binary(points: DataFrame, path: str) -> None:
    """Fixed-width parts per scan through the text-free binary layout.

    Each range of a scan becomes a headed part file; parts read back as ranges of one
    scan in name order. A path without a scheme means the cluster's default file system.
    A part is written under a hidden name and then renamed, so a task that is lost or runs
    twice never leaves half a part under its name.
    """
    spark = points.sparkSession
    place_of = spark._jvm.org.apache.hadoop.fs.Path(path)
    path = place_of.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place_of).toString()
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path

    def put(frames):
        import uuid

        import numpy as np
        import pandas as pd
        from pyarrow import fs

        for frame in frames:
            for (scan, block), part in frame.groupby(["scan_id", "block"]):
                part = part.sort_values("idx")
                rec = np.zeros(len(part), dtype=[("p", "<f4", 4), ("c", "u1", 3)])
                rec["p"] = part[["x", "y", "z", "intensity"]].to_numpy("float32")
                rec["c"] = part[["r", "g", "b"]].to_numpy("uint8")
                head = np.array([len(part), 1], dtype="<i4").tobytes()
                place, root = fs.FileSystem.from_uri(path)
                folder = f"{root}/scan_id={scan}"
                place.create_dir(folder, recursive=True)
                draft = f"{folder}/.part-{uuid.uuid4().hex}"
                with place.open_output_stream(draft) as f:
                    f.write(head + rec.tobytes())
                place.move(draft, f"{folder}/part-{int(block):08d}.bin")
                yield pd.DataFrame({"scan_id": [scan], "block": [block], "n": [len(part)]})

    blocks = points.withColumn("block", F.floor(F.col("idx") / RANGE_RECORDS))
    done = blocks.repartition("scan_id", "block").sortWithinPartitions("scan_id", "block").groupBy("scan_id", "block").applyInPandas(
        lambda part: next(put([part])), "scan_id long, block long, n long")
    done.agg(F.sum("n")).first()
