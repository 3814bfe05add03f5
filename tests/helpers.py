"""Comparing Spark results with DuckDB's."""

import datetime
import decimal
import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    """One form for values that mean the same."""
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return pd.Timestamp(v).tz_localize(None).isoformat() if pd.Timestamp(v).tz is None else pd.Timestamp(v).tz_convert("UTC").tz_localize(None).isoformat()
    return str(v)


def content(df: pd.DataFrame):
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df[names].itertuples(index=False, name=None)), key=repr)
