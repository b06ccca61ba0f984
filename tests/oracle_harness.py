"""Run registered queries on Spark and their SQL on DuckDB; compare results.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict[str, str]:
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    res = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            res[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, res[name]) if verbose else None
            continue
        ts = time.time() - t0
        if name not in sqls:
            res[name] = f"rows-only {len(srows)}"
            print(f"{name:28s} {res[name]} ({ts:.1f}s)") if verbose else None
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [c[0] for c in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            res[name] = f"DUCK ERROR {str(e)[:300]}"
            print(name, res[name]) if verbose else None
            continue
        sc, sr = rows_of(scols, srows)
        dc, dr = rows_of(dcols, drows)
        if sc != dc:
            res[name] = f"COLUMNS differ spark={sc} duck={dc}"
        elif len(sr) != len(dr):
            res[name] = f"ROWCOUNT spark={len(sr)} duck={len(dr)}"
        elif sr != dr:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            res[name] = f"VALUES differ ({len(sr)} rows) e.g. {diff}"
        else:
            res[name] = f"OK {len(sr)} rows"
        if verbose:
            print(f"{name:28s} {res[name]} ({ts:.1f}s)", flush=True)
    return res


if __name__ == "__main__":
    from headway.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", 8)
    r = compare(spark, sf, names)
    bad = {k: v for k, v in r.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    print(f"{len(r) - len(bad)}/{len(r)} ok")
    sys.exit(1 if bad else 0)
