"""Compare queries with their SQL on the given tables: python tests/compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads=4; SET TimeZone='UTC'")
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of_sql(con, sql: str):
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def rows_of_df(df):
    cols = df.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(_plain(r[i]) for i in order) for r in df.collect()), key=repr)


def main(args: list[str]) -> int:
    import __spark_entry__ as e
    from siltstone.session import local_session

    sf = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a] or list(e.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = views(sf), 0
    for n in names:
        t = time.time()
        try:
            got = rows_of_df(e.queries()[n](spark, sf))
            took = time.time() - t
            sql = e.oracle_sql().get(n)
            want = rows_of_sql(con, sql) if sql else None
            ok = "rows only" if want is None else got == want
            print(f"{n}: {ok} {len(got[1])} rows {took:.1f}s sql {time.time() - t - took:.1f}s", flush=True)
            if want is not None and got != want:
                bad += 1
                a, b = set(map(repr, got[1])), set(map(repr, want[1]))
                print("  cols", got[0], want[0], "only spark", sorted(a - b)[:3], len(a - b), "only sql", sorted(b - a)[:3], len(b - a))
        except Exception as x:
            bad += 1
            print(f"{n}: ERROR {str(x)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
