"""Rows of two engines, compared without regard to order."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(d):
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        numeric = df[c].dtype.kind in "iufb" or str(df[c].dtype).startswith("Int")
        as_float = numeric and str(df[c].dtype) not in ("bool", "boolean")
        df[c] = [
            "" if v is None or (not isinstance(v, (list, dict, np.ndarray)) and pd.isna(v)) else repr(round(float(v), 6) + 0.0) if as_float else str(v)
            for v in df[c]
        ]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    x, y = plain(a), plain(b)
    assert len(x) == len(y)
    pd.testing.assert_frame_equal(x, y, check_dtype=False)
