"""Comparison of one query with its SQL in a second engine."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW \"{path.stem}\" AS SELECT * FROM '{path}'")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def _plain(cell):
    return None if isinstance(cell, float) and math.isnan(cell) else cell


def _sort_key(row):
    return tuple((c is None, "" if c is None else f"{c:.6g}" if isinstance(c, float) else str(c)) for c in row)


def differences(columns, rows, oracle_columns, oracle, tolerance=1e-9) -> list[str]:
    if sorted(columns) != sorted(oracle_columns):
        return [f"columns {sorted(columns)} / {sorted(oracle_columns)}"]
    if len(rows) != len(oracle):
        return [f"{len(rows)} rows / {len(oracle)} rows"]
    order = sorted(columns)
    ours = sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=_sort_key)
    theirs = sorted((tuple(_plain(r[oracle_columns.index(c)]) for c in order) for r in oracle), key=_sort_key)
    found = []
    for a, b in zip(ours, theirs):
        for c, x, y in zip(order, a, b):
            if isinstance(x, float) and isinstance(y, float):
                same = x == y or abs(x - y) <= tolerance * max(abs(x), abs(y))
            else:
                same = x == y and isinstance(x, float) == isinstance(y, float)
            if not same:
                found.append(f"{c}: {x!r} / {y!r}")
    return found
