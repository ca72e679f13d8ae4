"""Run a query in Spark and its SQL in DuckDB and compare the two row sets."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("pointgrid-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


TIMES: dict = {}


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else repr(float(int(v)))
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 1e15 else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    t0 = time.time()
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    res = con.execute(sql)
    want_cols, want = normal([d[0] for d in res.description], res.fetchall())
    TIMES.update(run=t1 - t0, sql=time.time() - t1, rows=len(got))
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        a, b = set(got), set(want)
        only_g, only_w = sorted(a - b)[:3], sorted(b - a)[:3]
        return (f"rows {len(got)} vs {len(want)}, differing {len(a - b)}/{len(b - a)}\n   cols  {got_cols}"
                f"\n   spark {only_g}\n   sql   {only_w}")
    return None


def main(argv):
    import traceback

    import __spark_entry__ as entry

    sf = argv[0] if argv else "sf0.001"
    sf_dir = f"/root/testdata/{sf}"
    keys = argv[1:]
    spark, con = session(), connect(sf_dir)
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if keys and not any(key.startswith(k) for k in keys):
            continue
        t = time.time()
        try:
            if key in sql:
                msg = compare(spark, con, sf_dir, fn, sql[key])
            else:
                n = len(fn(spark, sf_dir).collect())
                TIMES.update(run=0, sql=0, rows=n)
                msg = None
        except Exception as ex:  # noqa: BLE001
            text = str(ex).split("JVM stacktrace")[0]
            msg = f"{type(ex).__name__}: {text[:1500]}"
            if "-v" in argv:
                traceback.print_exc()
        took = time.time() - t
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {key} {took:.1f}s sql {TIMES.get('sql', 0):.1f}s rows {TIMES.get('rows', 0)} {'' if key in sql else '(rows only)'} {msg or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
