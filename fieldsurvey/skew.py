"""Finding groups too large for one task.

Ordered windows and full outer joins put all rows of a key into one task, and
the engine's adaptive skew handling covers neither. The operators that need
them therefore look for heavy keys first and treat those apart. The search
estimates the size of keys from a random part of the key columns, so that it
shuffles next to nothing, and then counts the candidates exactly. It decides
where rows are placed, never which rows are used: results do not depend on it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsurvey.scratch import shared_folder

# Rows of one key that one task may sort and hold on disk.
HEAVY_ROWS = 20_000_000
# Key rows sent to every executor; beyond it the engine joins by shuffle.
BROADCAST_KEYS = 100_000
# Rows of any width sent to every executor, measured as text.
BROADCAST_BYTES = 64 << 20


def fixed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def search_fraction(max_rows: int) -> float:
    """Part of the rows looked at, so that a heavy key is met about 2,000 times."""
    return min(1.0, 2_000 / max_rows)


def looked_at(df: DataFrame, max_rows: int) -> DataFrame:
    fraction = search_fraction(max_rows)
    return df if fraction == 1.0 else df.sample(fraction, seed=1)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all rows, written as text, have at most ``limit`` bytes."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0]
    return (size or 0) <= limit


def heavy_groups(df: DataFrame, by: list[str], max_rows: int) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows and their count ``_n``, or None.

    The table has at most ``rows / max_rows`` rows. Whether there will be any is
    not known before, so the shared folder must be there in any case.
    """
    shared_folder(df.sparkSession)
    met = looked_at(df.select(*by), max_rows).groupBy(*by).agg(F.count("*").alias("_n"))
    candidates = met.filter(F.col("_n") > max_rows * search_fraction(max_rows) / 2)
    if candidates.isEmpty():
        return None
    rows = rows_in(df.select(*by), fixed(candidates), by)
    heavy = fixed(rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > max_rows))
    return None if heavy.isEmpty() else heavy


def _match(df: DataFrame, keys: DataFrame, by: list[str], how: str) -> DataFrame:
    renamed = keys.select(*[F.col(k).alias(f"_key_{k}") for k in by])
    if renamed.count() <= BROADCAST_KEYS and fits_broadcast(renamed):
        renamed = F.broadcast(renamed)
    return df.join(renamed, same_key(df, renamed, by, "_key_"), how)


def same_key(a: DataFrame, b: DataFrame, by: list[str], prefix: str) -> Column:
    """Equality of keys in which NULL equals NULL; ``b`` names carry ``prefix``."""
    return reduce(and_, [a[k].eqNullSafe(b[prefix + k]) for k in by])


def rows_in(df: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    return _match(df, keys, by, "left_semi")


def rows_not_in(df: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    return _match(df, keys, by, "left_anti")
