"""Run registered Spark queries and their DuckDB oracle side by side.

Usage: python tests/oracle_compare.py [sf_dir] [name-substring ...]
Prints one line per query: exact / close / MISMATCH with details.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    try:
        import decimal

        if isinstance(v, decimal.Decimal):
            return _norm(float(v), digits)
    except Exception:  # noqa: BLE001
        pass
    return v


def rows_of(records, cols, digits):
    out = [tuple(_norm(r[c], digits) for c in cols) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [r.asDict(recursive=True) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    if sql is None:
        return f"{name:32s} rows-only  n={len(s_rows)}  spark={t1 - t0:.1f}s"
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = [dict(zip(d_cols, r)) for r in cur.fetchall()]
    if sorted(s_cols) != sorted(d_cols):
        return f"{name:32s} MISMATCH columns spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return f"{name:32s} MISMATCH rows spark={len(s_rows)} duck={len(d_rows)}"
    cols = sorted(s_cols)
    if rows_of(s_rows, cols, None) == rows_of(d_rows, cols, None):
        return f"{name:32s} exact      n={len(s_rows)}  spark={t1 - t0:.1f}s"
    a, b = rows_of(s_rows, cols, 9), rows_of(d_rows, cols, 9)
    if a == b:
        return f"{name:32s} close(9)   n={len(s_rows)}  spark={t1 - t0:.1f}s"
    for x, y in zip(a, b):
        if x != y:
            diff = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
            return f"{name:32s} MISMATCH values n={len(a)} first diff {diff[:4]}"
    return f"{name:32s} MISMATCH ?"


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    from churnkit.session import get_session
    import __spark_entry__ as e

    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            line = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as ex:  # noqa: BLE001
            line = f"{name:32s} ERROR {type(ex).__name__}: {str(ex)[:300]}"
        bad += ("MISMATCH" in line) or ("ERROR" in line)
        print(line, flush=True)
    print(f"done, {bad} bad")


if __name__ == "__main__":
    main()
