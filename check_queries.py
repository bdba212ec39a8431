"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

usage: python check_queries.py [--sf DIR] [--section NAME] [query ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb
import pandas as pd

from voxmill.session import build_session

def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)]
    return pdf.sort_values(list(pdf.columns), kind="stable", ignore_index=True) if len(pdf) else pdf


def mismatch(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if not len(left):
        return "no rows"
    left, right = canonical(left), canonical(right)
    for c in left.columns:
        if left[c].dtype.kind != right[c].dtype.kind:
            return f"type of {c}: {left[c].dtype} != {right[c].dtype}"
        same = (left[c] == right[c]) | (left[c].isna() & right[c].isna())
        if not same.all():
            at = int((~same).idxmax())
            return (f"{c}: {int((~same).sum())} differ, e.g.\n   {left.iloc[at].to_dict()}\n"
                    f"   {right.iloc[at].to_dict()}")
    return None


def main() -> int:
    import importlib
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--section")
    args.add_argument("names", nargs="*")
    opt = args.parse_args()
    from voxmill.catalog import load
    if opt.section:
        from voxmill.catalog import base
        for s in opt.section.split(","):
            importlib.import_module(f"voxmill.catalog.{s}")
        queries = {n: f for n, f in base.QUERIES.items()
                   if f.__module__.rsplit(".", 1)[1] in opt.section.split(",")}
        oracles = base.ORACLES
    else:
        queries, oracles = load()
    names = opt.names or list(queries)
    con = duckdb.connect()
    for path in glob.glob(f"{opt.sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                   "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        began = time.time()
        try:
            got = queries[name](spark, opt.sf).toPandas()
            took = time.time() - began
            if name not in oracles:
                print(f"rows {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            problem = mismatch(got, want)
            print(f"{'BAD ' if problem else 'ok  '} {name}: {len(got)} rows, spark {took:.1f}s, all {time.time() - began:.1f}s"
                  + (f"\n  {problem}" if problem else ""), flush=True)
            bad += bool(problem)
        except Exception as err:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {type(err).__name__} {str(err)[:1500]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
