"""Compares a registered query with its SQL twin, by name-sorted columns and sorted rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """(equal, message)."""
    got = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(sql_columns):
        return False, f"columns {sorted(df.columns)} against {sorted(sql_columns)}"
    a, b = rows_of(df.columns, got), rows_of(sql_columns, expected)
    if a == b:
        return True, f"{len(a)} rows"
    extra = [r for r in a if r not in set(b)][:2]
    lacking = [r for r in b if r not in set(a)][:2]
    return False, f"rows {len(a)} against {len(b)}; only here {extra}; only there {lacking}"
