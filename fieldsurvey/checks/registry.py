"""Registration of a query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers the function under its own name with the SQL that must agree."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return register


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; negative zero becomes zero."""
    return F.round(c, digits) + F.lit(0.0)


def rounded_sql(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE"


def round_all(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Every double column rounded, to ``other`` digits where named."""
    cells = [rounded(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*cells)
