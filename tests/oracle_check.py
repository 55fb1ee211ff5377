"""Run registered queries in Spark and their DuckDB oracle SQL side by side and
compare column names, row counts and order-insensitive values.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from jobsight.sources.fixtures import BASE_TABLES  # noqa: E402


def duck(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        p = f"{d}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if v is pd.NaT:
        return None
    if isinstance(v, (np.floating, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, np.bool_):
        return bool(v)
    if isinstance(v, pd.Timestamp):
        if pd.isna(v):
            return None
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if isinstance(v, dt.datetime):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def compare(spark, con, q, d: str) -> tuple[bool, str]:
    t0 = time.time()
    sp = q.fn(spark, d).toPandas()
    t1 = time.time()
    if q.sql is None:
        return True, f"rows-only {len(sp)} rows ({t1 - t0:.1f}s)"
    od = con.execute(q.sql).df()
    if sorted(sp.columns) != sorted(od.columns):
        return False, f"columns differ: spark={sorted(sp.columns)} oracle={sorted(od.columns)}"
    if len(sp) != len(od):
        return False, f"row count spark={len(sp)} oracle={len(od)}"
    a, b = rows_of(sp), rows_of(od)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({len(sp)} rows), first: {diff}"
    return True, f"{len(sp)} rows ({t1 - t0:.1f}s)"


def main(argv):
    d = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    prefixes = argv[2:]
    from jobsight.plans.registry import all_queries
    from jobsight.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(d)
    bad = 0
    for name, q in sorted(all_queries().items()):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, msg = compare(spark, con, q, d)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name}: {msg}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
