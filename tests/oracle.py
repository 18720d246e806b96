"""Side-by-side runs of a query and its SQL."""

import glob
import math
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
    return con


def _value(v):
    return round(v, 9) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


def rows(cursor_or_df):
    if hasattr(cursor_or_df, "collect"):
        columns = sorted(cursor_or_df.columns)
        found = [tuple(_value(r[c]) for c in columns) for r in cursor_or_df.collect()]
    else:
        names = [d[0] for d in cursor_or_df.description]
        columns = sorted(names)
        found = [tuple(_value(r[names.index(c)]) for c in columns) for r in cursor_or_df.fetchall()]
    return columns, sorted(found, key=lambda r: [(v is None, str(v)) for v in r])
