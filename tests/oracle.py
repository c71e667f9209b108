"""Comparison of a query's rows with its SQL twin's, by value and regardless of order."""

import glob
import math
import os

import pandas as pd


def value(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else v
    return v


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def views(folder):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = path + "/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con
