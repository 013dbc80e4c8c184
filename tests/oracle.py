"""Run registered queries in Spark and DuckDB and compare whole results.

python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def normal(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int,)):
        return ("n", float(v))
    if isinstance(v, decimal.Decimal):
        return ("n", float(v))
    if isinstance(v, float):
        return ("n", "nan") if math.isnan(v) else ("n", float(f"{v:.12g}"))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("t", dt.datetime(v.year, v.month, v.day).isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(normal(x) for x in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, normal(x)) for k, x in v.items())))
    return ("s", v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    """None if equal (or no SQL is given), else a text saying how they differ."""
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got[1])
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", len(got[1])
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first:\n   spark {bad[0][0]}\n   duck  {bad[0][1]}", len(got[1])
    return None, len(got[1])


def session(cpus="8", partitions="8"):
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{cpus}]").appName("oracle")
            .config("spark.sql.shuffle.partitions", partitions)
            .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    import __spark_entry__ as e

    sf_dir = f"/root/testdata/sf{a.sf}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), []
    for name, fn in e.queries().items():
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        start = time.time()
        sql = e.oracle_sql().get(name)
        try:
            diff, rows = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as ex:
            diff, rows = f"{type(ex).__name__}: {str(ex)[:700]}", -1
        mark = "FAIL" if diff else ("ok  " if sql else "rows")
        print(f"{mark} {name:34s} {rows:8d} rows {time.time() - start:6.2f}s {diff or ''}", flush=True)
        if diff:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
