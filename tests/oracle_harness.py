"""Run queries() against oracle_sql() on DuckDB, the way the driver's gate does.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
Compares sorted column names, row counts and an order-insensitive hash of the
values (doubles rounded to 9 places).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def frame_digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(keyed).encode()).hexdigest()
    return [cols[i] for i in order], len(rows), h, keyed


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK-ERROR", str(e)[:400])
            if verbose:
                print(name, "SPARK-ERROR", str(e)[:800], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("rows-only", len(srows))
            if verbose:
                print(f"{name}: rows-only {len(srows)} rows ({ts:.1f}s)", flush=True)
            continue
        try:
            rel = con.sql(sqls[name])
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL-ERROR", str(e)[:400])
            if verbose:
                print(name, "SQL-ERROR", str(e)[:800], flush=True)
            continue
        sc, sn, sh, sk = frame_digest(scols, srows)
        dc, dn, dh, dk = frame_digest(dcols, drows)
        ok = sc == dc and sn == dn and sh == dh
        results[name] = ("OK" if ok else "MISMATCH", (sc, dc, sn, dn))
        if verbose:
            print(f"{name}: {'OK' if ok else 'MISMATCH'} rows spark={sn} duck={dn} ({ts:.1f}s)",
                  flush=True)
            if not ok:
                print("  spark cols", sc, "\n  duck  cols", dc)
                diff_s = [r for r in sk if r not in set(dk)][:3]
                diff_d = [r for r in dk if r not in set(sk)][:3]
                print("  only spark:", diff_s, "\n  only duck:", diff_d)
    return results


if __name__ == "__main__":
    from quire.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark()
    res = check(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "rows-only")}
    print("SUMMARY", len(res), "queries,", len(bad), "not ok:", sorted(bad))
