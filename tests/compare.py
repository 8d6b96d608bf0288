"""Runs queries against their SQL in DuckDB: python tests/compare.py [--sf DIR] [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

SF = "/root/testdata/sf0.01"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            path = os.path.join(sf_dir, name)
            path += "/*.parquet" if os.path.isdir(path) else ""
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(str(_plain(r[k])) for k in order) for r in rows)


def compare(spark, name: str, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t = time.time()
    df = query(spark, sf_dir)
    ours = df.collect()
    took = time.time() - t
    if sql is None:
        return True, f"{len(ours)} rows, no SQL, {took:.1f} s"
    con = duck(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    if a == b:
        return True, f"{len(ours)} rows, {took:.1f} s"
    return False, f"{len(ours)} and {len(theirs)} rows; only ours {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from threadloom.session import local_session

    args = sys.argv[1:]
    if args[:1] == ["--sf"]:
        SF, args = args[1], args[2:]
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in args or q:
        try:
            ok, said = compare(session, key, q[key], o.get(key), SF)
        except Exception as e:
            ok, said = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", key, said, flush=True)
    sys.exit(bad > 0)
