"""Run registered queries in Spark and their oracle SQL in DuckDB, and compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]

Per query: row count, column names, and an order-insensitive hash of the
values (exact, and with doubles rounded to 6 places).
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from growthlens.plans.registry import all_queries  # noqa: E402
from growthlens.session import get_spark  # noqa: E402


def _norm(v, digits):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        if digits is not None:
            v = round(v, digits)
            if v == 0:
                v = 0.0
        return repr(float(v))
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x, digits) for x in v) + "]"
    return str(v)


def digest(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i], digits) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and os.path.isdir(args[0]):
        sf_dir, args = args[0], args[1:]
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    qs = all_queries()
    names = args or list(qs)
    bad = 0
    for n in names:
        q = qs[n]
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{n:32s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        t1 = time.time()
        if q.oracle is None:
            print(f"{n:32s} rows={len(srows)} (no oracle) {t1-t0:.1f}s")
            continue
        try:
            cur = con.execute(q.oracle)
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{n:32s} ORACLE ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        same_cols = sorted(scols) == sorted(ocols)
        h1s, ls = digest(scols, srows, None)
        h1o, lo = digest(ocols, orows, None)
        h2s, _ = digest(scols, srows, 6)
        h2o, _ = digest(ocols, orows, 6)
        ok = same_cols and len(srows) == len(orows) and h1s == h1o
        status = "OK" if ok else ("OK~6" if same_cols and h2s == h2o else "MISMATCH")
        if status != "OK":
            bad += status == "MISMATCH"
        print(f"{n:32s} {status:8s} rows={len(srows)}/{len(orows)} {t1-t0:.1f}s")
        if status == "MISMATCH":
            if not same_cols:
                print("   spark cols:", sorted(scols))
                print("   oracle cols:", sorted(ocols))
            else:
                d1 = sorted(set(ls) - set(lo))[:3]
                d2 = sorted(set(lo) - set(ls))[:3]
                print("   cols:", sorted(scols))
                print("   spark only:", d1)
                print("   oracle only:", d2)
    print("mismatches/errors:", bad)


if __name__ == "__main__":
    main()
