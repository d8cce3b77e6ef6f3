"""Operators that look at neighbouring rows or at group totals.

Row order is always given explicitly. A group that fits one task is handled by
one window. A heavier one is first cut into consecutive slices by a range
partitioning on the full sort key, and each slice is told the first row of the
next one and the sums of those before it, so that no task ever holds a whole heavy
group. ``ordered_scan`` does all of that for groups of any size; the Column builders
``next_value``, ``finite_diff``, ``neighbour_geomean``, ``share_of_group`` and ``share_of_base``
are single windows, for groups that fit one task, such as grouped counts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldsurvey.functions.values import col, ratio
from fieldsurvey.skew import BROADCAST_KEYS, HEAVY_ROWS, fits_broadcast, fixed, heavy_groups, rows_in, rows_not_in, same_key

SLICE = "_slice"
#: Running functions: the aggregate, and how the value of earlier slices joins that of the own one.
RUNNING = {
    "sum": (F.sum, lambda before, own: F.coalesce(before + own, before, own)),
    "count": (F.count, lambda before, own: F.coalesce(before, F.lit(0)) + own),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def in_order(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def next_value(c: Column | str, by: Sequence[str], order: Sequence[str]) -> Column:
    """Value of the next row of the group, which one task holds; NULL on the last row."""
    return F.lead(col(c)).over(in_order(by, order))


def finite_diff(y: Column | str, x: Column | str, by: Sequence[str], order: Sequence[str]) -> Column:
    """Forward difference quotient of ``y`` over ``x``."""
    return ratio(next_value(y, by, order) - col(y), next_value(x, by, order) - col(x))


def neighbour_geomean(x: Column | str, by: Sequence[str], order: Sequence[str]) -> Column:
    """Geometric mean of this and the next value."""
    return F.sqrt(col(x) * next_value(x, by, order))


def slice_heavy_groups(
    df: DataFrame, by: Sequence[str], order: Sequence[str], max_rows: int | None = HEAVY_ROWS
) -> DataFrame:
    """``df`` with a column ``_slice``; heavy groups are cut into slices in ``order``.

    The number is 0 for groups left whole, and for the others it rises with
    ``order``; if no group is heavy it is a literal, which costs nothing. Rows of heavy groups are written to the shared folder
    once, so the numbers stay fixed when tasks are run again. ``order`` should
    end in a tie-breaker: rows equal in all of it stay in one slice.
    """
    by, order = list(by), list(order)
    heavy = None if max_rows is None else heavy_groups(df, by, max_rows)
    if heavy is None:
        return df.withColumn(SLICE, F.lit(0))
    rows = heavy.agg(F.sum("_n")).first()[0]
    ranged = rows_in(df, heavy, by).repartitionByRange(math.ceil(rows / max_rows), *by, *order)
    sliced = fixed(ranged.withColumn(SLICE, F.spark_partition_id() + 1))
    whole = rows_not_in(df, heavy, by).withColumn(SLICE, F.lit(0))
    return whole.unionByName(sliced)


def slice_keys(df: DataFrame, by: Sequence[str]) -> list[str]:
    """Partitioning columns for an ordered window over a possibly sliced frame."""
    return [*by, SLICE] if SLICE in df.columns else list(by)


def with_next(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Adds ``next_<c>`` for each of ``cols``, across slice borders as well."""
    by, order = list(by), list(order)
    keys = slice_keys(df, by)
    window = in_order(keys, order)
    ahead = {f"next_{c}": F.lead(c).over(window) for c in cols}
    if SLICE not in df.columns:
        return df.withColumns(ahead)
    needed = list(dict.fromkeys([*order, *cols]))
    heads = (
        df.filter(F.col(SLICE) > 0)
        .groupBy(*by, SLICE)
        .agg(F.min(F.struct(*needed)).alias("_head"))
    )
    border = (
        heads.withColumn(SLICE, F.lag(SLICE).over(in_order(by, [SLICE])))
        .filter(F.col(SLICE).isNotNull())
        .withColumnsRenamed({k: f"_border_{k}" for k in keys})
    )
    # The last row of a slice looks at the first one of the next slice.
    paired = df.withColumns({**ahead, "_inside": F.lead(F.lit(True)).over(window)})
    joined = paired.join(border, same_key(paired, border, keys, "_border_"), "left")
    crossed = {f"next_{c}": F.when(F.col("_inside"), F.col(f"next_{c}")).otherwise(F.col(f"_head.{c}")) for c in cols}
    return joined.withColumns(crossed).drop("_inside", "_head", *[f"_border_{k}" for k in keys])


def with_running(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Adds running values up to each row, across slice borders as well.

    ``columns`` maps a new name to a function of RUNNING and the column that it runs over. Missing
    cells are left out; a missing key is one group.
    """
    by, order = list(by), list(order)
    sliced = SLICE in df.columns
    own = in_order(slice_keys(df, by), order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({name: RUNNING[f][0](c).over(own) for name, (f, c) in columns.items()})
    if not sliced:
        return out
    # One row for each slice, not one for each row.
    earlier = in_order(by, [SLICE]).rowsBetween(Window.unboundedPreceding, -1)
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    keys = [*by, SLICE]
    carried = (
        df.filter(F.col(SLICE) > 0)
        .groupBy(*keys)
        .agg(*[RUNNING[f][0](c).alias(f"_before_{name}") for name, (f, c) in columns.items()])
        .withColumns({f"_before_{name}": again[f](f"_before_{name}").over(earlier) for name, (f, _) in columns.items()})
        .withColumnsRenamed({k: f"_carry_{k}" for k in keys})
    )
    joined = out.join(carried, same_key(out, carried, keys, "_carry_"), "left")
    whole = {name: RUNNING[f][1](F.col(f"_before_{name}"), F.col(name)) for name, (f, _) in columns.items()}
    return joined.withColumns(whole).drop(*[f"_before_{name}" for name in columns], *[f"_carry_{k}" for k in keys])


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    running: Mapping[str, tuple[str, str]] | None = None,
    ahead: Sequence[str] = (),
    max_rows: int | None = HEAVY_ROWS,
) -> DataFrame:
    """Running values (see :func:`with_running`) and next values (``next_<c>`` of ``ahead``) for groups of any size.

    ``order`` must tell rows of a group apart. No task holds more than about ``max_rows`` rows of a group;
    the result does not depend on it.
    """
    rows = df if SLICE in df.columns else slice_heavy_groups(df, by, order, max_rows)
    if ahead:
        rows = with_next(rows, by, order, ahead)
    if running:
        rows = with_running(rows, by, order, running)
    return rows if SLICE in df.columns else rows.drop(SLICE)


def with_share(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    base: str | None = None,
    name: str = "share",
    max_rows: int | None = HEAVY_ROWS,
    broadcast_rows: int = BROADCAST_KEYS,
) -> DataFrame:
    """Adds the share of ``value`` in its group's total of ``base``, by default of itself, for raw rows.

    Totals are made before rows are shuffled. If they are few, they are sent to all tasks and no row
    is moved. Otherwise rows meet their total by a join on the key; groups of more than ``max_rows`` rows,
    of which there are few, get theirs by broadcast instead. A missing key is a group; a missing
    total or one of zero gives no share.
    """
    by = list(by)
    sums = df.groupBy(*by).agg(F.sum(col(base or value)).alias("_total"), F.count("*").alias("_n"))
    totals = fixed(sums.withColumnsRenamed({k: f"_of_{k}" for k in by}))

    def joined(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found.drop("_n"), same_key(rows, found, by, "_of_"), "left")

    if totals.count() <= broadcast_rows and fits_broadcast(totals):
        parts = [joined(df, F.broadcast(totals))]
    elif max_rows is None:
        parts = [joined(df, totals)]
    else:
        heavy = totals.filter(F.col("_n") > max_rows)
        keys = heavy.select(*[F.col(f"_of_{k}").alias(k) for k in by])
        few = heavy.count() <= broadcast_rows and fits_broadcast(heavy)
        parts = [joined(rows_not_in(df, keys, by), totals.filter(F.col("_n") <= max_rows)), joined(rows_in(df, keys, by), F.broadcast(heavy) if few else heavy)]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.withColumn(name, ratio(value, "_total")).drop("_total", *[f"_of_{k}" for k in by])


def share_of_group(c: Column | str, by: Sequence[str]) -> Column:
    """Share of the value in the total of its group; for grouped counts, :func:`with_share` for raw rows."""
    return share_of_base(c, c, by)


def share_of_base(c: Column | str, base: Column | str, by: Sequence[str]) -> Column:
    """Value over the group total of another column, missing left out."""
    return ratio(c, F.sum(col(base)).over(Window.partitionBy(*by)))
