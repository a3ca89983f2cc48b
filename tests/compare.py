"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

import time
from pathlib import Path

import duckdb
import pandas as pd


def duck(sf_dir):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    rows = [tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(frame.columns), sorted(rows, key=repr)


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, pd.Timestamp):
        return value.strftime("%Y-%m-%d %H:%M:%S.%f")
    if hasattr(value, "strftime"):
        return value.strftime("%Y-%m-%d 00:00:00.000000")
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value.item() if hasattr(value, "item") else value


def difference(spark, con, query, sql, sf_dir):
    """None when both agree; otherwise a short description. Also both times."""
    start = time.time()
    ours = canonical(query(spark, sf_dir).toPandas())
    middle = time.time()
    theirs = canonical(con.execute(sql).df())
    times = (middle - start, time.time() - middle)
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}", times
    if ours[1] != theirs[1]:
        a, b = set(map(repr, ours[1])), set(map(repr, theirs[1]))
        return f"{len(ours[1])} vs {len(theirs[1])} rows; {sorted(a - b)[:3]} != {sorted(b - a)[:3]}", times
    return None, times
