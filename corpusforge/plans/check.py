"""Run registered queries in Spark and their oracle SQL in DuckDB; compare rows, columns, values."""

from __future__ import annotations

import argparse
import hashlib
import json
import math
import sys
import time

from corpusforge.plans import fixtures as fx


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in sorted(v.items())}
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([_norm(r[i]) for i in order], default=str, sort_keys=True) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in fx.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, name, build, sql, sf_dir, con):
    t0 = time.time()
    sdf = build(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["oracle_rows"] = len(drows)
    res["cols_match"] = sorted(scols) == sorted(dcols)
    res["hash_match"] = res["cols_match"] and _digest(scols, srows) == _digest(dcols, drows)
    res["status"] = "ok" if (res["hash_match"] and len(srows) == len(drows)) else "MISMATCH"
    if not res["cols_match"]:
        res["spark_cols"], res["oracle_cols"] = sorted(scols), sorted(dcols)
    return res


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    from corpusforge.plans.catalog import all_queries
    from corpusforge.session import local_session

    spark = local_session()
    con = duck(a.sf)
    qs = all_queries()
    names = a.names or list(qs)
    bad = 0
    for n in names:
        q = qs[n]
        try:
            r = compare(spark, n, q.build, q.sql, a.sf, con)
        except Exception as e:  # report and go on
            r = {"name": n, "status": "ERROR", "error": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("ok", "rows-only")
        print(json.dumps(r), flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
