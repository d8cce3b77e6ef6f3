"""Cover shares of survey points.

The cover operators are one conditional-count aggregation each: no window, no
pivot and no join, and a shuffle of one row per group and task. Their aggregate
lists are exposed so that a plan can compute all of them in the same pass.
Every list takes ``where``, the condition for a surveyed point.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsurvey.functions.values import count_ratio
from fieldsurvey.operators.groups import as_keys


def _in_name_order(shares: Mapping[str, Column]) -> list[Column]:
    return [shares[name].alias(name) for name in sorted(shares)]


def single_layer_shares(
    code: str, mapping: Mapping[str, str], totals: Mapping[str, Sequence[str]], where: Column
) -> list[Column]:
    """Share of each code among surveyed points, then sums of named shares.

    Codes outside ``mapping`` count in the base and get no column.
    """
    surveyed = F.count_if(where)
    shares = {name: count_ratio(F.count_if(where & (F.col(code) == k)), surveyed) for k, name in mapping.items()}
    sums = [sum((shares[p] for p in parts[1:]), shares[parts[0]]).alias(name) for name, parts in totals.items()]
    return _in_name_order(shares) + sums


def two_layer_shares(
    layer1: str, layer2: str, mapping: Mapping[str, str], base: str, where: Column
) -> list[Column]:
    """Hits of each code in either layer over the points of layer one.

    ``base="surveyed"`` counts points without a code in layer one as well,
    ``base="observed"`` does not. A group without any code has no shares.
    """
    seen1, seen2 = F.count_if(where & F.col(layer1).isNotNull()), F.count_if(where & F.col(layer2).isNotNull())
    if base == "surveyed":
        total = F.when(seen1 + seen2 > 0, F.count_if(where))
    elif base == "observed":
        total = seen1
    else:
        raise ValueError(f"base must be 'surveyed' or 'observed', not {base!r}")

    def hits(k: str) -> Column:
        return F.count_if(where & (F.col(layer1) == k)) + F.count_if(where & (F.col(layer2) == k))

    return _in_name_order({name: count_ratio(hits(k), total) for k, name in mapping.items()})


def canopy_total_shares(layer1: str, layer2: str, foliar: Sequence[str], where: Column) -> list[Column]:
    """Points with any first-layer code, and with a foliar code in either layer."""
    surveyed = F.count_if(where)
    leafy = F.col(layer1).isin(*foliar) | F.col(layer2).isin(*foliar)
    return [
        count_ratio(F.count_if(where & F.col(layer1).isNotNull()), surveyed).alias("can_total_prop"),
        count_ratio(F.count_if(where & leafy), surveyed).alias("can_foliar_prop"),
    ]


def overstory_total_shares(layer1: str, absent: str, where: Column) -> list[Column]:
    """Points with a live first layer; missing counts as not live."""
    live = F.count_if(where & (F.col(layer1) != absent))
    return [count_ratio(live, F.count_if(where)).alias("over_total_prop")]


def single_layer_cover(
    df: DataFrame, by: str | Sequence[str], code: str, mapping: Mapping[str, str], totals: Mapping[str, Sequence[str]]
) -> DataFrame:
    surveyed = df.na.drop(subset=[code])
    return surveyed.groupBy(*as_keys(by)).agg(*single_layer_shares(code, mapping, totals, F.lit(True)))


def two_layer_cover(
    df: DataFrame, by: str | Sequence[str], l1: str, l2: str, mapping: Mapping[str, str], base: str = "surveyed"
) -> DataFrame:
    """Groups without any code in either layer are left out."""
    coded = F.count(F.coalesce(F.col(l1), F.col(l2))).alias("_coded")
    shares = two_layer_shares(l1, l2, mapping, base, F.lit(True))
    return df.groupBy(*as_keys(by)).agg(*shares, coded).filter("_coded > 0").drop("_coded")


def canopy_totals(df: DataFrame, by: str | Sequence[str], l1: str, l2: str, foliar: Sequence[str]) -> DataFrame:
    return df.groupBy(*as_keys(by)).agg(*canopy_total_shares(l1, l2, foliar, F.lit(True)))


def overstory_total(df: DataFrame, by: str | Sequence[str], l1: str, absent: str) -> DataFrame:
    return df.groupBy(*as_keys(by)).agg(*overstory_total_shares(l1, absent, F.lit(True)))
