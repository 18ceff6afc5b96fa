"""Rows of two results as sorted tuples."""

import pandas as pd


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return repr(float(v) + 0.0)
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))


def tables(con, folder):
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create or replace view {name} as select * from '{folder}/{name}.parquet'")
