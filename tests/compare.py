"""Run a query and its SQL over the same tables and compare the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if v != v else v for v in row) for row in frame.itertuples(index=False)]
    return list(frame.columns), sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(spark_frame, sql_frame) -> str | None:
    """None when equal, otherwise a short description of the first difference."""
    left_cols, left = _canonical(spark_frame)
    right_cols, right = _canonical(sql_frame)
    if left_cols != right_cols:
        return f"columns {left_cols} vs {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    off = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(off)} of {len(left)} rows differ, first {off[0]}" if off else None
