"""Run registered queries in Spark and DuckDB and compare rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    return int(x) if isinstance(x, bool) else float(x) if hasattr(x, "is_signed") else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, f, sql, sf_dir):
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"rows {len(got)} {len(want)} {bad}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from meridian.plans import registry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    con = connect(sf)
    for name in sys.argv[1:] or registry.QUERIES:
        t = time.time()
        try:
            said = compare(spark, con, name, registry.QUERIES[name], registry.ORACLE[name], sf) if name in registry.ORACLE else f"no oracle, {registry.QUERIES[name](spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
