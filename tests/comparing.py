"""Rows of a query against those of its SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return None if v is None else str(v)


def rows_of(table) -> Counter:
    """Counted rows of an Arrow table, columns by name."""
    names = sorted(table.column_names)
    return Counter(zip(*[[_cell(v) for v in table.column(n).to_pylist()] for n in names])) if names else Counter()


def assert_same(spark_table, sql_table) -> None:
    assert sorted(spark_table.column_names) == sorted(sql_table.column_names)
    a, b = rows_of(spark_table), rows_of(sql_table)
    assert a == b, f"only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}"
