"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]

Compares row count, column names (sorted) and an order-insensitive multiset of
rows, with doubles rounded to 6 decimals.  Mirrors the driver's check closely
enough to catch mismatches before a round ends.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from dwellframe.plans.registry import load_all  # noqa: E402
from dwellframe.session import local_session  # noqa: E402
from dwellframe.sources.tables import TABLES  # noqa: E402


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(records, cols):
    return Counter(tuple(_norm(r[c]) for c in cols) for r in records)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    reg = load_all()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, spec in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = spec.build(spark, sf_dir)
            srows = [r.asDict(recursive=True) for r in sdf.collect()]
            scols = sorted(sdf.columns)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if spec.sql is None:
            print(f"rows  {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.execute(spec.sql)
            dcols_raw = [d[0] for d in rel.description]
            drows = [dict(zip(dcols_raw, r)) for r in rel.fetchall()]
            dcols = sorted(dcols_raw)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: duckdb error {str(e)[:400]}")
            continue
        if scols != dcols:
            bad += 1
            print(f"FAIL  {name}: columns spark={scols} duck={dcols}")
            continue
        stypes = dict(sdf.dtypes)
        dtypes = {d[0]: str(d[1]) for d in rel.description}
        tmis = [(c, stypes[c], dtypes[c]) for c in scols if _TYPES.get(stypes[c], stypes[c]) != dtypes[c]]
        if tmis:
            print(f"TYPE  {name}: {tmis}")
        a, b = _rows(srows, scols), _rows(drows, scols)
        if len(srows) != len(drows) or a != b:
            bad += 1
            diff1 = list((a - b).items())[:3]
            diff2 = list((b - a).items())[:3]
            print(f"FAIL  {name}: rows spark={len(srows)} duck={len(drows)} "
                  f"spark-only={diff1} duck-only={diff2}")
            continue
        print(f"ok    {name}: {len(srows)} rows {ts:.1f}s")
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
