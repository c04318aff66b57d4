"""Run registered queries in Spark and DuckDB side by side and compare values.

usage: python tools/check_oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from placewise.plans import registry  # noqa: E402
from placewise.session import local_session  # noqa: E402
from placewise.sources.views import BASE_TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v)


def _type(v):
    return type(v).__name__


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("prefixes", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(int(os.environ.get("CHECK_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    qs, sqls = registry.spark_queries(), registry.oracle_statements()
    bad = 0
    for name, fn in qs.items():
        if args.prefixes and not any(name == p or name.startswith(p + "_") or name.startswith(p) and p.endswith("*") for p in args.prefixes):
            if not any(p.endswith("*") and name.startswith(p[:-1]) for p in args.prefixes):
                continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            rows = df.collect()
            cols = df.columns
            ts = time.time() - t0
            if name not in sqls:
                print(f"ROWS {name}: {len(rows)} rows {ts:.1f}s {rows[:1]}", flush=True)
                continue
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
            order = sorted(cols)
            if order != sorted(dcols):
                print(f"BAD  {name}: columns {order} vs {sorted(dcols)}", flush=True)
                bad += 1
                continue
            a = [tuple(r[c] for c in order) for r in rows]
            b = [tuple(r[dcols.index(c)] for c in order) for r in drows]
            sa, sb = sorted(tuple(map(_norm, r)) for r in a), sorted(tuple(map(_norm, r)) for r in b)
            ta = {c: {_type(r[i]) for r in a} - {"NoneType"} for i, c in enumerate(order)}
            tb = {c: {_type(r[i]) for r in b} - {"NoneType"} for i, c in enumerate(order)}
            mism = {c: (ta[c], tb[c]) for c in order if ta[c] != tb[c]}
            stypes = dict(df.dtypes)
            dtypes = {d[0]: str(d[1]) for d in cur.description}
            want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
            for c in order:
                if want.get(stypes[c], stypes[c]) != dtypes[c]:
                    mism[c] = (stypes[c], dtypes[c])
            if sa == sb and not mism:
                print(f"ok   {name}: {len(a)} rows {ts:.1f}s", flush=True)
            else:
                bad += 1
                print(f"BAD  {name}: rows {len(a)} vs {len(b)} types {mism} {ts:.1f}s", flush=True)
                only_a = [r for r in sa if r not in set(sb)][:3]
                only_b = [r for r in sb if r not in set(sa)][:3]
                print("   cols ", order, "\n   spark", *only_a, "\n   duck ", *only_b, sep="\n    ", flush=True)
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: {type(exc).__name__} {str(exc)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
