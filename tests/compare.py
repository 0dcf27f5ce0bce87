"""Run registered queries next to their checking SQL and compare every value.

Usage: python tests/compare.py [folder] [name part ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    """One comparable spelling per value."""
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) and abs(value) < 2**53 else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return rows_of(names, cur.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def difference(left, right):
    """None when equal, else a short description."""
    (lc, lr), (rc, rr) = left, right
    if lc != rc:
        return f"columns {sorted(set(lc) ^ set(rc))}"
    if len(lr) != len(rr):
        return f"rows {len(lr)} against {len(rr)}"
    for a, b in zip(lr, rr):
        if a != b:
            return "\n    " + "\n    ".join(
                f"{c}: {x!r} | {y!r}" for c, x, y in zip(lc, a, b) if x != y
            )
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from crivo.session import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = get_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            got = spark_rows(run(spark, folder))
            took = time.time() - start
            if name not in oracles:
                print(f"rows {name} {len(got[1])} {took:.1f}s", flush=True)
                continue
            diff = difference(got, sql_rows(con, oracles[name]))
        except Exception as error:  # report and go on with the next query
            diff, took = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {took:.1f}s {diff or len(got[1])}",
              flush=True)
    print(f"{bad} differences")
    sys.exit(bool(bad))
