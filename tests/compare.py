"""Comparison of a query's rows with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        kind = out[c].dtype
        if kind == bool or str(kind) == "boolean":
            out[c] = out[c].astype(str).str.lower()
        elif kind.kind in "iuf" or str(kind) in ("Int64", "Int32", "Float64"):
            out[c] = out[c].astype(float)
        elif str(kind).startswith("datetime"):
            out[c] = out[c].dt.strftime("%Y-%m-%d")
        else:
            out[c] = [None if v is None or v != v else v if isinstance(v, str) else str(v)[:10] if hasattr(v, "isoformat") else str(v).lower() for v in out[c]]
    order = out.round(5).fillna("~").astype(str).apply("|".join, axis=1).argsort(kind="stable") if len(out) else []
    return out.iloc[order].reset_index(drop=True)


def same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) == len(expected)
    a, b = plain(got), plain(expected)
    for c in a.columns:
        if a[c].dtype.kind == "f" and b[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c], b[c], rtol=1e-6, atol=2e-6, equal_nan=True, err_msg=c)
        else:
            assert a[c].fillna("~").astype(str).tolist() == b[c].fillna("~").astype(str).tolist(), c
