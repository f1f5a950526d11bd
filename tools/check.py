"""Run every query at a scale factor and compare it with its SQL in DuckDB.

    python tools/check.py [--dir /root/testdata/sf0.01] [name-part ...]
"""

from __future__ import annotations

import argparse
import pathlib
import sys
import time
import traceback

import duckdb
import numpy as np

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
from wardlight.plans import ORACLES, QUERIES  # noqa: E402
from wardlight.session import local_session  # noqa: E402

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT",
}


def norm(v):
    if isinstance(v, float):
        return "nan" if np.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--dir", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark = local_session("check")
    con = duckdb.connect()
    for path in sorted(pathlib.Path(opts.dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    bad = 0
    for name, fn in QUERIES.items():
        if opts.names and not any(n in name for n in opts.names):
            continue
        start = time.time()
        try:
            df = fn(spark, opts.dir)
            cols = sorted(df.columns)
            got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
        except Exception:
            bad += 1
            print(f"FAIL  {name}: {traceback.format_exc(limit=-3)[:1500]}")
            continue
        spent = time.time() - start
        if name not in ORACLES:
            print(f"rows  {name}: {len(got)} rows, {spent:.2f}s")
            continue
        try:
            rel = con.sql(ORACLES[name])
            types = dict(zip(rel.columns, map(str, rel.types)))
            order = [rel.columns.index(c) for c in cols]
            want = sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
        except Exception as e:
            bad += 1
            print(f"FAIL  {name}: oracle: {str(e)[:600]}")
            continue
        kinds = {c: TYPES.get(t, t) for c, t in df.dtypes}
        diff = {c: (kinds.get(c), types.get(c)) for c in {*kinds, *types} if kinds.get(c) != types.get(c)}
        if diff or got != want:
            bad += 1
            miss = [(g, w) for g, w in zip(got, want) if g != w][:3]
            print(f"DIFF  {name}: rows {len(got)} vs {len(want)}; types {diff}; {cols} first differences {miss}")
        else:
            print(f"ok    {name}: {len(got)} rows, {spent:.2f}s")
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
