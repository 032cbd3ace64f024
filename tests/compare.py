"""Spark results against SQL results."""

import os

import duckdb


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def value(x):
    if x is None or str(x) in ("nan", "<NA>", "NaT"):
        return None
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(map(value, x))
    if isinstance(x, bool) or type(x).__name__ in ("bool_", "bool"):
        return bool(x)
    if isinstance(x, float) or type(x).__name__.startswith(("float", "int")):
        return round(float(x), 6)
    return x


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False, name=None)), key=repr)
