"""Run registered queries in Spark and their SQL in DuckDB and compare rows.

Usage: python tools/check.py [--sf 0.01] [--only PREFIX ...] [--time]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from gridloom.session import local_session

TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def compare(df, rel) -> tuple[str, int]:
    names = sorted(df.columns)
    duck_names = sorted(rel.columns)
    if names != duck_names:
        return f"columns {names} != {duck_names}", 0
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    odd = [
        f"{f.name}:{f.dataType.simpleString()}/{duck_types[f.name]}"
        for f in df.schema.fields
        if TYPES.get(f.dataType.simpleString(), "?") != duck_types[f.name]
    ]
    a = sorted([tuple(canonical(r[n]) for n in names) for r in df.select(*names).collect()])
    order = [rel.columns.index(n) for n in names]
    b = sorted([tuple(canonical(r[i]) for i in order) for r in rel.fetchall()])
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        return (
            f"rows {len(a)} vs {len(b)}, differ {len(left)}/{len(right)}\n   {names}\n"
            f"   spark {sorted(left)[:3]}\n   duck  {sorted(right)[:3]}", len(a)
        )
    if odd:
        return "types " + ", ".join(odd), len(a)
    return "", len(a)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.001")
    parser.add_argument("--only", nargs="*", default=[])
    parser.add_argument("--plan", action="store_true")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    from gridloom.catalog import ORACLES, QUERIES

    spark = local_session(8)
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    bad = 0
    for name, fn in QUERIES.items():
        if args.only and not any(name.startswith(p) for p in args.only):
            continue
        started = time.time()
        try:
            df = fn(spark, folder)
            if args.plan:
                df.explain("formatted")
            if name in ORACLES:
                message, n = compare(df, con.sql(ORACLES[name]))
            else:
                n, message = df.count(), ""
        except Exception as e:  # a broken query must not hide the next one
            message, n = f"{type(e).__name__}: {str(e)[:600]}", 0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(message) or n == 0
        mark = "FAIL" if message else ("EMPTY" if n == 0 else "ok")
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{mark:5} {name:34} {n:8d} rows {time.time() - started:6.2f}s{kind} {message}", flush=True)
    print(f"{bad} not ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
