"""Runs a query and its SQL over the same tables, for tests and by hand: python -m tests.oracle [sf] [name...]."""

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return db


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: None if x is None else round(x, 5) if isinstance(x, float) else x
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=lambda r: tuple((x is not None, str(x)) for x in r))


def differences(spark, db, query, text, sf_dir):
    got = query(spark, sf_dir)
    a = rows(got.columns, [tuple(r) for r in got.collect()])
    cur = db.execute(text)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns), (names, got.columns)
    b = rows(names, cur.fetchall())

    def same(x, y):
        return x == y or all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-5, abs_tol=2e-5)) for p, q in zip(x, y))

    bad = [(x, y) for x, y in zip(a, b) if not same(x, y)]
    return len(a), len(b), bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db, oracle = connect(sf), e.oracle_sql()
    for name, q in e.queries().items():
        if len(sys.argv) > 2 and not any(x in name for x in sys.argv[2:]) or (len(sys.argv) < 3 and (name.startswith("op") or name == "pipeline")):
            continue
        t = time.time()
        try:
            if name in oracle:
                n, m, bad = differences(spark, db, q, oracle[name], sf)
                print("ok " if n == m and not bad else "BAD", name, n, m, bad[:2], round(time.time() - t, 1), flush=True)
            else:
                print("row", name, q(spark, sf).count(), round(time.time() - t, 1), flush=True)
        except Exception as x:  # noqa: BLE001
            print("ERR", name, str(x)[:500].replace("\n", " "), flush=True)
