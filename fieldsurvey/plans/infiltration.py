"""Infiltration time series to hydraulic properties, one row per location.

All three fitting methods and their R squared come from one aggregation. For
locations that fit one task it shares the single shuffle of the window that
pairs neighbouring readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsurvey.functions.aggregates import fit_line, fit_r2, fit_two_term
from fieldsurvey.functions.hydrology import (
    HydraulicParams,
    coef_a1,
    coef_a2,
    conductivity,
    conductivity_per_hour,
    front_head,
    sorptivity,
    sorptivity_per_hour,
)
from fieldsurvey.functions.values import band, finite, ratio, row_mean, to_number
from fieldsurvey.operators.frames import lookup, null_negative, relocate_first, split_key, with_params
from fieldsurvey.operators.ordered import SLICE, slice_heavy_groups, with_next
from fieldsurvey.operators.reshape import to_long
from fieldsurvey.skew import HEAVY_ROWS
from fieldsurvey.study import KEY_PARTS, SEVERITY_BOUNDS, SEVERITY_ELSE, grade_default

# Readings up to this time (s) still show the contact layer.
MIN_TIME = 24
ESTIMATES = ["c1_ci", "c2_ci", "c1_cl", "c2_cl", "c1_dl", "c2_dl"]


def root_features(df: DataFrame, time: str = "time_sec", y: str = "i_cm") -> DataFrame:
    """Adds the root of time and infiltration per root of time; no shuffle."""
    rooted = df.withColumn("sqrt_time", finite(F.sqrt(time)))
    return rooted.withColumn("i_per_sqrt_time", ratio(y, "sqrt_time"))


def infiltration_features(
    df: DataFrame,
    by: str = "location_id",
    time: str = "time_sec",
    y: str = "i_cm",
    order: Sequence[str] = (),
    max_rows: int | None = HEAVY_ROWS,
) -> DataFrame:
    """Adds root features and those of neighbouring readings.

    ``order`` defaults to time, then infiltration. ``max_rows=None`` skips the
    search for heavy locations, for frames already sliced or known to have none.
    """
    order = list(order) or [time, y]
    if SLICE not in df.columns:
        df = slice_heavy_groups(df, [by], order, max_rows)
    paired = with_next(root_features(df, time, y), [by], order, ["sqrt_time", y])
    return (
        paired.withColumns(
            {
                "geomean_sqrt_time": F.sqrt(F.col("sqrt_time") * F.col("next_sqrt_time")),
                "di_dsqrt_time": ratio(
                    F.col(f"next_{y}") - F.col(y), F.col("next_sqrt_time") - F.col("sqrt_time")
                ),
            }
        )
        .drop("next_sqrt_time", f"next_{y}", SLICE)
    )


def fit_ci(y: str = "i_cm") -> list[Column]:
    """Cumulative infiltration: two terms, all readings."""
    c1, c2 = fit_two_term("sqrt_time", y)
    return [c1.alias("c1_ci"), c2.alias("c2_ci")]


def fit_cl(time: str = "time_sec", min_time: float = MIN_TIME, r2_filtered: bool = False) -> list[Column]:
    """Cumulative linearization: coefficients from late readings, R squared from all."""
    late = F.col(time) > min_time
    c1, c2 = fit_line("i_per_sqrt_time", "sqrt_time", late)
    r2 = fit_r2("i_per_sqrt_time", "sqrt_time", late if r2_filtered else None)
    return [c1.alias("c1_cl"), c2.alias("c2_cl"), r2.alias("r2_cl")]


def fit_dl() -> list[Column]:
    """Differentiated linearization: the second coefficient is half the slope."""
    c1, slope = fit_line("di_dsqrt_time", "geomean_sqrt_time")
    r2 = fit_r2("di_dsqrt_time", "geomean_sqrt_time")
    return [c1.alias("c1_dl"), (slope / 2).alias("c2_dl"), r2.alias("r2_dl")]


def fit_methods(
    features: DataFrame, by: str = "location_id", time: str = "time_sec", y: str = "i_cm",
    min_time: float = MIN_TIME, r2_filtered: bool = False,
) -> DataFrame:
    """All estimates and R squared, one row per location."""
    return features.groupBy(by).agg(*fit_ci(y), *fit_cl(time, min_time, r2_filtered), *fit_dl())


def coefficients_long(fits: DataFrame, by: str = "location_id") -> DataFrame:
    """One row per location, method, term and estimate."""
    long = to_long(fits, [by], ESTIMATES)
    parts = F.split("term", "_")
    return long.select(by, parts[1].alias("method"), parts[0].alias("term"), "estimate")


def mean_estimates(fits: DataFrame) -> DataFrame:
    """Drops negative estimates and averages the others over the methods."""
    return null_negative(fits, ESTIMATES).withColumns(
        {
            "c1": row_mean("c1_ci", "c1_cl", "c1_dl"),
            "c2": row_mean("c2_ci", "c2_cl", "c2_dl"),
        }
    )


def hydraulic_properties(df: DataFrame, params: HydraulicParams) -> DataFrame:
    """Adds a1, a2, sorptivity, conductivity and front head to rows with c1, c2."""
    return (
        df.withColumns({"a1": coef_a1(params), "a2": coef_a2(params)})
        .withColumns({"s_cm_sec0_5": sorptivity("c1", "a1"), "kfs_cm_sec": conductivity("c2", "a2")})
        .withColumns({"s_mm_hr0_5": sorptivity_per_hour("s_cm_sec0_5"), "kfs_mm_hr": conductivity_per_hour("kfs_cm_sec")})
        .withColumn("hf_m", front_head("s_mm_hr0_5", "kfs_mm_hr", params))
    )


def with_site(df: DataFrame, key: str = "location_id", numeric: Sequence[str] = KEY_PARTS) -> DataFrame:
    """Adds the parts of the location key and the burn severity of the plot."""
    parts = split_key(df, key, KEY_PARTS)
    numbers = parts.withColumns({c: to_number(c) for c in numeric})
    return numbers.withColumn("burn_severity", band("plot_id", SEVERITY_BOUNDS, SEVERITY_ELSE))


def infiltration_fit(
    df: DataFrame,
    params: HydraulicParams = HydraulicParams(),
    grades: DataFrame | None = None,
    min_time: float = MIN_TIME,
    by: str = "location_id",
    order: Sequence[str] = (),
    max_rows: int | None = HEAVY_ROWS,
    r2_filtered: bool = False,
) -> DataFrame:
    """Readings (``by``, ``time_sec``, ``i_cm``) to the fit table."""
    needed = dict.fromkeys([by, "time_sec", "i_cm", *order, *([SLICE] if SLICE in df.columns else [])])
    features = infiltration_features(df.select(*needed), by, order=order, max_rows=max_rows)
    fits = mean_estimates(fit_methods(features, by, min_time=min_time, r2_filtered=r2_filtered))
    table = with_params(with_site(hydraulic_properties(fits, params), by), params)
    columns = [
        by, *KEY_PARTS, "burn_severity", "s_mm_hr0_5", "kfs_mm_hr", "hf_m",
        "c1_ci", "c2_ci", "c1_cl", "c2_cl", "r2_cl", "c1_dl", "c2_dl", "r2_dl",
        "a1", "a2", "c1", "c2", "s_cm_sec0_5", "kfs_cm_sec",
    ]
    table = relocate_first(table, columns)
    return table if grades is None else lookup(table, grades, by, grade_default())
