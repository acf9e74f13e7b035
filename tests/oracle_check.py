"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

    python tests/oracle_check.py [--sf DIR] [name ...]

Columns are compared by name (sorted), rows order-insensitively; floats must
agree to 1e-9 relative ("approx") and are also hashed after rounding to 6
decimals ("hash"), the stricter form a value-hash gate sees.
"""
from __future__ import annotations

import argparse
import datetime
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else round(v, 6)  # a whole number may come as either type where there are NULLs
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if hasattr(v, "isoformat"):
        try:
            return v.replace(tzinfo=None).isoformat()
        except TypeError:
            return v.isoformat()
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, str)):
        seq = v.tolist() if hasattr(v, "tolist") else v
        return tuple(_norm(x) for x in seq)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


def _close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    return a == b


def compare(sdf: pd.DataFrame, ddf: pd.DataFrame) -> dict:
    out = {"spark_rows": len(sdf), "oracle_rows": len(ddf),
           "columns_match": sorted(sdf.columns) == sorted(ddf.columns)}
    if not out["columns_match"]:
        out["spark_cols"] = sorted(sdf.columns)
        out["oracle_cols"] = sorted(ddf.columns)
        return out
    a, b = rows_of(sdf), rows_of(ddf)
    out["hash_match"] = hashlib.md5(repr(a).encode()).hexdigest() == hashlib.md5(repr(b).encode()).hexdigest()
    out["approx_match"] = len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    if not out["approx_match"]:
        diff = [(x, y) for x, y in zip(a, b) if not _close(x, y)][:3]
        out["first_diffs"] = diff
        out["cols"] = sorted(sdf.columns)
    return out


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as E
    from shelfwise.session import build_session
    spark = build_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(args.sf)
    names = args.names or sorted(qs)
    bad = 0
    for n in names:
        t = time.time()
        try:
            sdf = qs[n](spark, args.sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{n}: SPARK ERROR {str(e)[:800]}")
            bad += 1
            continue
        ts = time.time() - t
        if n not in sqls:
            print(f"{n}: rows-only {len(sdf)} rows ({ts:.1f}s)")
            continue
        try:
            ddf = con.execute(sqls[n]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{n}: ORACLE ERROR {str(e)[:800]}")
            bad += 1
            continue
        res = compare(sdf, ddf)
        ok = res.get("hash_match") and res.get("approx_match")
        bad += 0 if ok else 1
        print(f"{n}: {'OK' if ok else 'MISMATCH'} ({ts:.1f}s) {res if not ok else res['spark_rows']}")
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
