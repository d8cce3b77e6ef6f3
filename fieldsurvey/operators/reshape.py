"""Long to wide and back, with schemas fixed in advance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_wide(
    df: DataFrame,
    by: str | Sequence[str],
    key: str,
    value: str,
    values: Sequence[str],
    fill: float | None = 0,
) -> DataFrame:
    """One column per entry of ``values``, in alphabetical order.

    One aggregation per group; a cell met twice is an error, an empty cell
    becomes ``fill``.
    """
    cells = []
    for name in sorted(values):
        here = F.col(key) == name
        twice = F.raise_error(F.lit(f"more than one row for {name}"))
        cell = F.when(F.count_if(here) > 1, twice).otherwise(F.max(F.when(here, F.col(value))))
        cells.append((cell if fill is None else F.coalesce(cell, F.lit(fill))).alias(name))
    return df.groupBy(*([by] if isinstance(by, str) else by)).agg(*cells)


def to_long(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], key: str = "term", value: str = "estimate"
) -> DataFrame:
    """One row per id and column."""
    return df.unpivot(list(ids), list(cols), key, value)
