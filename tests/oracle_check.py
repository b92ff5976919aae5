"""Run registered queries in Spark and their oracle SQL in DuckDB, and compare.

Comparison: same column names, same row count, same multiset of rows after
normalising values (floats rounded to 6 places, dates as ISO text).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from ridgeline.sources.tables import BASE_TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = os.environ.get("ORACLE_EXACT") == "1"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, _dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    return v


def rows_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [tuple(norm(x) for x in r) for r in res.fetchall()]
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: spark={scols} oracle={dcols}"
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    s = rows_key([tuple(r[i] for i in si) for r in srows])
    d = rows_key([tuple(r[i] for i in di) for r in drows])
    if s != d:
        from collections import Counter
        cs, cd = Counter(s), Counter(d)
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        return False, (f"rows spark={len(s)} oracle={len(d)} cols={order}\n   only spark: {only_s}"
                       f"\n   only oracle: {only_d}")
    return True, f"{len(s)} rows, spark {t1 - t0:.2f}s"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as E
    from ridgeline.session import build_session

    spark = build_session()
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in oracle:
            print(f"--   {name}: no oracle")
            continue
        try:
            ok, msg = compare(spark, con, name, fn, oracle[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'}  {name}: {msg}", flush=True)
    print(f"{len([n for n in qs if not only or n in only]) - bad} ok, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
