"""Compare registered Spark queries with their DuckDB oracle SQL (local twin of the driver check).

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0  # -0.0 equals 0.0; nothing is rounded
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    srows = df.collect()
    scols = df.columns
    ts = time.time() - t
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), sec=round(ts, 2))
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    ok_cols = sorted(scols) == sorted(dcols)
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    ok = ok_cols and a == b
    info = dict(name=name, ok=ok, rows=(len(srows), len(drows)), sec=round(ts, 2))
    if not ok_cols:
        info["cols"] = (sorted(scols), sorted(dcols))
    elif not ok:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        info["diff"] = diff
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    info["dtypes"] = {c: (types.get(c), str(d[1])) for c, d in zip(dcols, res.description)}
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from demandlens.session import get_spark

    spark = get_spark("local[8]", 8)
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in (names or list(qs)):
        try:
            info = compare(spark, con, n, qs[n], orc.get(n), sf_dir)
        except Exception as e:  # report and continue
            info = dict(name=n, ok=False, error=repr(e)[:800])
        if info.get("ok") is False:
            bad += 1
        dt = info.pop("dtypes", {})
        print(info, flush=True)
        if info.get("ok") is False and dt:
            print("   types", dt, flush=True)
    print("FAILED", bad, "of", len(names or qs))


if __name__ == "__main__":
    main(sys.argv)
