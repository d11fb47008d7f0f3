"""Run registered Spark plans and their DuckDB oracles side by side.

    python tests/oracle_check.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive hash of values
(doubles rounded to 6 places), like the driver's correctness gate.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from rentlens.plans import registry  # noqa: E402
from rentlens.sources.tables import TABLES, table_path  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        try:
            return v.replace(tzinfo=None).isoformat()
        except TypeError:
            return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def frame_rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


def digest(rows) -> str:
    h = hashlib.sha256()
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()[:16]


def main(argv):
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    registry.load_all()
    from rentlens.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    bad = 0
    for name in names or list(registry.QUERIES):
        t0 = time.time()
        try:
            sdf = registry.QUERIES[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:600]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = registry.ORACLES.get(name)
        if sql is None:
            print(f"ROWS {name}: spark rows={len(sdf)} ({ts:.1f}s), no oracle")
            continue
        try:
            odf = con.execute(sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        sc, sr = frame_rows(sdf)
        oc, orow = frame_rows(odf)
        ok = sc == oc and len(sr) == len(orow) and digest(sr) == digest(orow)
        if ok:
            print(f"OK   {name}: rows={len(sr)} ({ts:.1f}s)")
        else:
            bad += 1
            print(f"FAIL {name}: cols {sc} vs {oc}; rows {len(sr)} vs {len(orow)}")
            if sc == oc:
                ss, os_ = set(sr), set(orow)
                print("   spark-only:", list(ss - os_)[:3])
                print("   oracle-only:", list(os_ - ss)[:3])
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
