"""Run registered queries and compare them with their SQL in DuckDB: python tools/check.py [-s sf] [name ...]"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from helixframe.plans import registry
from helixframe.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="0.01")
    ap.add_argument("-m", help="only this plan module")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    folder = f"/root/testdata/sf{a.s}"
    if a.m:
        registry.MODULES = tuple(a.m.split(","))
    suite = registry.load_all()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    spark = local_session("check")
    names = [n for n in suite.queries if not a.names or any(n.startswith(x) for x in a.names)]
    bad = []
    for name in names:
        t0 = time.time()
        try:
            df = suite.queries[name](spark, folder)
            got = df.collect()
            secs = time.time() - t0
            cols, mine = rows_of(df.columns, got)
            types = dict(df.dtypes)
            if name not in suite.oracle:
                print(f"rows  {name} {len(mine)} {secs:.1f}s", flush=True)
                continue
            rel = con.execute(suite.oracle[name])
            dtypes = {d[0]: str(d[1]) for d in rel.description}
            ocols, theirs = rows_of([d[0] for d in rel.description], rel.fetchall())
            same_types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
            off = [f"{c}:{types[c]}/{dtypes.get(c)}" for c in cols if same_types.get(types[c]) != dtypes.get(c)]
            if cols != ocols:
                bad.append(name)
                print(f"COLS  {name} {cols} {ocols}", flush=True)
            elif mine != theirs:
                bad.append(name)
                diff = [(m, o) for m, o in zip(mine, theirs) if m != o][:2]
                print(f"DIFF  {name} rows {len(mine)}/{len(theirs)} {secs:.1f}s {cols} {str(diff)[:700]}", flush=True)
            else:
                print(f"ok    {name} {len(mine)} {secs:.1f}s {'TYPES ' + ' '.join(off) if off else ''}{' EMPTY' if not mine else ''}", flush=True)
        except Exception as e:  # noqa: BLE001 - report and go on to the next query
            bad.append(name)
            print(f"FAIL  {name} {type(e).__name__} {str(e)[:600]}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} fine; bad: {bad}")


if __name__ == "__main__":
    main()
