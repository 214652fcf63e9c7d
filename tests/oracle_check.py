"""Run registered queries in Spark and their SQL in DuckDB and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: ok / MISMATCH with row counts and column sets.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(records, cols):
    out = []
    for r in records:
        out.append(tuple(_norm(r[c]) for c in cols))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        if name not in sql:
            df = qs[name](spark, sf_dir)
            n = df.count()
            results[name] = ("rows-only", n)
            if verbose:
                print(f"{name:28s} rows-only n={n} ({time.time() - t0:.1f}s)", flush=True)
            continue
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [r.asDict() for r in sdf.collect()]
            scols = sorted(sdf.columns)
            rel = con.sql(sql[name])
            dcols = sorted(rel.columns)
            drows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("ERROR", str(e)[:300])
            print(f"{name:28s} ERROR {str(e)[:300]}", flush=True)
            continue
        ok = scols == dcols and len(srows) == len(drows)
        if ok:
            a, b = _rows(srows, scols), _rows(drows, dcols)
            ok = a == b
            if not ok and verbose:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                print(f"   first diffs: {diff}")
        results[name] = ("ok" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            extra = "" if scols == dcols else f" cols spark={scols} duck={dcols}"
            print(f"{name:28s} {'ok' if ok else 'MISMATCH'} spark={len(srows)} duck={len(drows)}"
                  f"{extra} ({time.time() - t0:.1f}s)", flush=True)
    return results


if __name__ == "__main__":
    from tillroll.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("ok", "rows-only")]
    print("FAILED:", bad)
