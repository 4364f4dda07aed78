"""Run registered queries next to their check SQL in DuckDB: python tests/check.py [sf] [names]."""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def frames_equal(a, b):
    import numpy as np
    import pandas as pd

    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    cols = sorted(a.columns)

    def canon(v):
        if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NaT or v is pd.NA:
            return "~"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, np.integer)):
            return repr(float(v))
        if isinstance(v, (float, np.floating)):
            return repr(float(v) + 0.0)
        if hasattr(v, "as_tuple"):
            return repr(float(v))
        if isinstance(v, (list, np.ndarray)):
            return str([canon(x) for x in v])
        return str(v)

    ra = sorted(tuple(canon(v) for v in r) for r in a[cols].itertuples(index=False, name=None))
    rb = sorted(tuple(canon(v) for v in r) for r in b[cols].itertuples(index=False, name=None))
    bad = [(x, y) for x, y in zip(ra, rb) if x != y]
    return f"{len(bad)} of {len(ra)} rows differ, e.g. {cols} {bad[:3]}" if bad else None


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def main():
    import __spark_entry__ as e
    from duochron.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con, queries, sql = duck(sf_dir), e.queries(), e.oracle_sql()
    failed = []
    for name in names or queries:
        t = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            t1 = time.time() - t
            if name not in sql:
                print(f"{name}: {len(got)} rows, no SQL {t1:.1f}s", flush=True)
                if names:
                    print(got.head(8).to_string())
                continue
            t = time.time()
            want = con.execute(sql[name]).df()
            err = frames_equal(got, want)
            print(f"{name}: {'ok' if err is None else 'FAIL ' + err} rows={len(got)} spark={t1:.1f}s duck={time.time() - t:.1f}s", flush=True)
            if err:
                failed.append(name)
        except Exception as x:  # noqa: BLE001
            print(f"{name}: ERROR {type(x).__name__} {str(x)[:400]}", flush=True)
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
