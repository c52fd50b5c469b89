"""Compare a query's rows with its SQL question's rows, as sets of rounded values."""

import datetime
import decimal
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 4) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return str(v.date())
    return None if v is None else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql):
    """Empty, or what differs."""
    got = table(df.columns, df.collect())
    cur = con.execute(sql)
    want = table([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}: {[r for r in got[1] if r not in set(want[1])][:2]} against {[r for r in want[1] if r not in set(got[1])][:2]}"
    off = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(off)} rows differ: {off[:2]}" if off else ""


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder = sys.argv[1]
    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", "/tmp/spark-wh").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, oracles = duck(folder), e.oracle_sql()
    names = sys.argv[2:] or [n for n in e.queries() if not n.startswith("op") and n != "pipeline"]
    for n in names:
        t = time.time()
        try:
            df = e.queries()[n](spark, folder)
            said = differences(df, con, oracles[n]) if n in oracles else f"rows only: {df.count()}"
        except Exception as x:
            said = "FAILED " + " ".join(str(x).split())[:420]
        print(f"{n} {time.time() - t:.1f} s {said or 'same'}", flush=True)
