"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tests/oracle_harness.py [sf_dir] [key ...]
Prints one line per query: OK / MISMATCH / ERROR / ROWS-ONLY.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None  # pandas turns NULL doubles into NaN; compare both as missing
        return float(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (not isinstance(x, (list, tuple, dict)) and not hasattr(x, "tolist") and pd.isna(x) and not isinstance(x, float)) else x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, sf_dir, keys=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in sorted(qs):
        if keys and k not in keys:
            continue
        t0 = time.time()
        try:
            sdf = qs[k](spark, sf_dir)
            spdf = sdf.toPandas()
            t1 = time.time()
            if k not in sqls:
                results[k] = ("ROWS-ONLY", len(spdf), round(t1 - t0, 2))
                if verbose:
                    print(f"ROWS-ONLY {k}: {len(spdf)} rows {t1 - t0:.1f}s", flush=True)
                continue
            dpdf = con.execute(sqls[k]).df()
            sc, sr = rows_of(spdf)
            dc, dr = rows_of(dpdf)
            if sc != dc:
                status = f"MISMATCH cols spark={sc} duck={dc}"
            elif len(sr) != len(dr):
                status = f"MISMATCH rows spark={len(sr)} duck={len(dr)}"
            elif sr != dr:
                diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
                status = f"MISMATCH values e.g. {diff}"
            else:
                status = "OK"
            results[k] = (status, len(sr), round(t1 - t0, 2))
            if verbose:
                print(f"{status[:600]} {k}: {len(sr)} rows {t1 - t0:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            results[k] = ("ERROR", str(e)[:300], 0)
            if verbose:
                print(f"ERROR {k}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
                traceback.print_exc(limit=3)
    return results


if __name__ == "__main__":
    from tessera.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = set(sys.argv[2:]) or None
    spark = build_session()
    res = compare(spark, sf, keys)
    bad = [k for k, v in res.items() if not (v[0] == "OK" or v[0] == "ROWS-ONLY")]
    print(f"SUMMARY ok={sum(v[0] == 'OK' for v in res.values())} rows_only="
          f"{sum(v[0] == 'ROWS-ONLY' for v in res.values())} bad={len(bad)} {sorted(bad)}")
