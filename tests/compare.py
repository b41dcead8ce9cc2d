"""Compare a query's result with its SQL twin, value by value."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def kind(values: pd.Series) -> str:
    """Whole numbers with nulls among them count as such, though pandas makes floats of them."""
    if pd.api.types.is_float_dtype(values.dtype):
        whole = values.isna().any() and (values.dropna() % 1 == 0).all()
        return "int" if whole else "float"
    return "int" if pd.api.types.is_integer_dtype(values.dtype) else "other"


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.astype(object).where(df.notna(), "<null>").map(repr)
    return df.loc[text.sort_values(list(text.columns)).index].reset_index(drop=True)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> list[str]:
    """What differs between two results, in any row order. Empty: nothing."""
    if sorted(left.columns) != sorted(right.columns):
        return [f"columns {sorted(left.columns)} / {sorted(right.columns)}"]
    if len(left) != len(right):
        return [f"rows {len(left)} / {len(right)}"]
    left, right = tidy(left), tidy(right)
    found = []
    for c in left.columns:
        if kind(left[c]) != kind(right[c]) and len(left) and left[c].notna().any():
            found.append(f"{c}: type {left[c].dtype} / {right[c].dtype}")
        a = left[c].astype(object).where(left[c].notna(), None)
        b = right[c].astype(object).where(right[c].notna(), None)
        bad = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
        if bad:
            found.append(f"{c}: {len(bad)} differ, e.g. {a[bad[0]]!r} / {b[bad[0]]!r}")
    return found
