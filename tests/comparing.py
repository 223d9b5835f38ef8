"""How tests compare result tables."""

import numbers

import pandas as pd


def shown(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, bool) or not isinstance(v, numbers.Real):
        return str(v)
    return str(int(v)) if v == int(v) else f"{float(v):.9g}"


def rows_of(frame):
    """Rows as sorted tuples, columns by name; whole numbers exactly, others to nine digits."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(shown, r)) for r in frame.astype(object).itertuples(index=False, name=None))
