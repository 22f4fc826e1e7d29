"""Runs registered queries next to their SQL and compares every value."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("barloom")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if v != v else v + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19].replace(" 00:00:00", "")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    return v


def key(row):
    return tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=key)


def compare(spark, con, name, run, sql, sf_dir):
    t0 = time.time()
    df = run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return f"rows={len(got)} no-sql", t1 - t0, True
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns differ: {got_cols} vs {want_cols}", t1 - t0, False
    if len(got) != len(want):
        return f"row count {len(got)} vs {len(want)}", t1 - t0, False
    if not got:
        return "rows=0 EMPTY", t1 - t0, True
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y]
        return f"{len(bad)}/{len(got)} rows differ, first {str(diff)[:600]} in {str(a)[:200]}", t1 - t0, False
    return f"rows={len(got)} ok", t1 - t0, True


def main(argv):
    import __spark_entry__ as e

    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("sf")]
    for a in argv:
        if a.startswith("sf"):
            sf_dir = f"/root/testdata/{a}"
    spark, con = session(), duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    chosen = [n for n in qs if not names or n in names]
    fails = []
    for n in chosen:
        try:
            msg, sec, ok = compare(spark, con, n, qs[n], sqls.get(n), sf_dir)
        except Exception as ex:  # report and go on
            msg, sec, ok = f"ERROR {type(ex).__name__} {str(ex)[:700]}", 0, False
        if not ok or sec > 8 or "EMPTY" in msg or len(chosen) < 12:
            print(f"{'ok  ' if ok else 'FAIL'} {n:28s} {sec:6.1f}s {msg}", flush=True)
        if not ok:
            fails.append(n)
    print(f"{len(chosen) - len(fails)}/{len(chosen)} ok", fails)


if __name__ == "__main__":
    if sys.argv[1:2] == ["mod"]:
        import barloom.plans as p

        p.MODULES[:] = sys.argv[2].split(",")
        main(sys.argv[3:])
    else:
        main(sys.argv[1:])
