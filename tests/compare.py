"""Rows of two frames as sorted tuples, so that engines' types and orders do not matter."""

import numpy as np
import pandas as pd


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and np.isnan(x):
        return ""
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating, int, np.integer)):
        return str(int(x)) if float(x).is_integer() and abs(x) < 2**53 else repr(round(float(x), 8)) if isinstance(x, (float, np.floating)) else str(x)
    return str(x)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))
