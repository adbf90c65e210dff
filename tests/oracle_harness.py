"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python -m tests.oracle_harness /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
       "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def canon(cols: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return [cols[i] for i in order], out


def compare(spark, con, sf_dir: str, name: str, queries, oracle) -> dict:
    t0 = time.time()
    sdf = queries[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t_spark, 2)}
    if name not in oracle:
        res["status"] = "rows-only"
        return res
    rel = con.sql(oracle[name])
    drows = rel.fetchall()
    scols, s = canon(sdf.columns, srows)
    dcols, d = canon(list(rel.columns), drows)
    res["duck_rows"] = len(drows)
    if scols != dcols:
        res["status"] = f"SCHEMA {scols} != {dcols}"
    elif s != d:
        diff = [r for r in s if r not in set(d)][:3]
        diff2 = [r for r in d if r not in set(s)][:3]
        res["status"] = f"VALUES spark-only={diff} duck-only={diff2}"
    else:
        res["status"] = "ok"
    return res


def main(argv: list[str]) -> int:
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries

    from ledgerlake.session import build_local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = build_local_session(8)
    qs, ors = queries(), oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in names or list(qs):
        try:
            r = compare(spark, con, sf_dir, n, qs, ors)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{bad} failing of {len(names or qs)}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
