"""Spark-vs-DuckDB parity check of registered queries (the driver's correctness gate,
re-created for local use): row count, column names, order-insensitive values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> bool:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E

    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = sdf.collect()
    t1 = time.time()
    if sql is None:
        if verbose:
            print(f"{name}: rows-only {len(s_rows)} rows ({t1 - t0:.1f}s)")
        return True
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    ok = True
    msgs = []
    if sorted(s_cols) != sorted(d_cols):
        ok = False
        msgs.append(f"columns differ: spark={s_cols} duck={d_cols}")
    if len(s_rows) != len(d_rows):
        ok = False
        msgs.append(f"row count spark={len(s_rows)} duck={len(d_rows)}")
    if ok:
        order = sorted(s_cols)
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        sc = Counter(tuple(_norm(r[i]) for i in si) for r in s_rows)
        dc = Counter(tuple(_norm(r[i]) for i in di) for r in d_rows)
        if sc != dc:
            ok = False
            only_s = list((sc - dc).elements())[:3]
            only_d = list((dc - sc).elements())[:3]
            msgs.append(f"values differ; spark-only {only_s}; duck-only {only_d}")
    if verbose:
        print(f"{name}: {'OK' if ok else 'FAIL'} {len(s_rows)} rows ({t1 - t0:.1f}s) {' | '.join(msgs)}")
    return ok


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from glyphframe.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark = local_session(8)
    import __spark_entry__ as E

    names = names or sorted(E.queries())
    con = duck(sf)
    bad = [n for n in names if not compare(spark, n, sf, con)]
    print("FAILED:", bad)
