"""Operators on columns of one frame; none of them shuffles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsurvey.functions.hydrology import HydraulicParams
from fieldsurvey.functions.values import (
    NULL_TOKENS,
    not_negative,
    value,
    without_tokens,
)


def relocate_first(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``cols`` first, the other columns after them in their old order."""
    return df.select(*cols, *[c for c in df.columns if c not in set(cols)])


def with_params(df: DataFrame, p: HydraulicParams) -> DataFrame:
    """The run parameters as columns of every row."""
    return df.withColumns(
        {
            "soil_texture_mdi": value(p.texture),
            "n": value(p.n),
            "theta_i_cm3_cm3": value(p.theta_i),
            "theta_s_cm3_cm3": value(p.theta_s),
            "mdiradius_cm": value(p.radius_cm),
            "alpha_percm": value(p.alpha_per_cm),
            "tension_cm": value(p.tension_cm),
        }
    )


def null_where(df: DataFrame, cols: Sequence[str], predicate) -> DataFrame:
    """NULL in each of ``cols`` where ``predicate(column)`` is true."""
    return df.withColumns({c: F.when(predicate(F.col(c)), None).otherwise(F.col(c)) for c in cols})


def null_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: not_negative(c) for c in cols})


def null_tokens(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    return df.withColumns({c: without_tokens(c, tokens) for c in cols})


def fill_text(df: DataFrame, cols: Sequence[str], text: str = "") -> DataFrame:
    return df.na.fill(text, list(cols))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(0, list(cols))


def lookup(df: DataFrame, dim: DataFrame, on: str, default: Column | None = None) -> DataFrame:
    """Attributes of ``dim`` by key; a non-missing ``default`` goes before them.

    A small dimension is broadcast by the engine from its own size estimate; a
    large one is joined by shuffle, where adaptive skew splitting applies.
    """
    joined = df.join(dim, on, "left")
    if default is None:
        return joined
    return joined.withColumns({c: F.coalesce(default, F.col(c)) for c in dim.columns if c != on})


def split_key(df: DataFrame, c: str, into: Sequence[str], sep: str = "_") -> DataFrame:
    """Parts of a composite key as text columns; short keys are padded with NULL."""
    parts = F.split(F.col(c), re.escape(sep))
    return df.withColumns(
        {name: without_tokens(F.get(parts, F.lit(i))) for i, name in enumerate(into)}
    )
