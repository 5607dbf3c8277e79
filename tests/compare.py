"""Compare every query with its SQL in DuckDB: ``python tests/compare.py [sf folder] [names...]``."""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# Iterative and approximate queries, which SQL cannot say; tests compare them with brute force.
WITHOUT_SQL = {"tag_clusters_by_mean", "similar_pairs_lsh_given"}


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("tagweave-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return (0, "")
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, (int, float)):
        return (2, f"{float(x):.6f}")
    return (3, str(x))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def check(spark, con, folder: str, name: str, fn, sql: str | None):
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - t0
    if sql is None:
        # Only these and the optional operators may do without; their own tests use brute force.
        return name in WITHOUT_SQL or bool(re.match(r"op\d+_|pipeline$", name)), f"{len(got)} rows (no SQL)", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    a, b = canonical(df.columns, [tuple(r) for r in got]), canonical(names, want)
    if a[0] != b[0]:
        return False, f"columns {a[0]} != {b[0]}", took
    simple = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema.fields
           if simple.get(f.dataType.simpleString()) != kinds[f.name]]
    if len(a[1]) != len(b[1]):
        return False, f"{len(a[1])} rows != {len(b[1])}", took
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a[1])} rows differ, e.g. {str(bad[0])[:600]}", took
    return not odd, f"{len(got)} rows" + (f" types {odd}" if odd else ""), took


if __name__ == "__main__":
    import __spark_entry__ as e

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), duck(folder)
    sqls, wanted = e.oracle_sql(), sys.argv[2:]
    failed = []
    for name, fn in e.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, note, took = check(spark, con, folder, name, fn, sqls.get(name))
        except Exception as exc:
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        print(("ok  " if ok else "BAD ") + f"{name:24s} {took:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
