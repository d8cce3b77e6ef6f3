"""Hydraulic properties from infiltration coefficients (Zhang 1997).

Parameters may be numbers or Columns, so one formula serves a single run
setting and a table with one parameter row per site.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsurvey.functions.values import col, finite, ratio, value

MM_PER_CM = 10.0
SECONDS_PER_HOUR = 3600.0
ROOT_SECONDS_PER_ROOT_HOUR = 60.0
MM_PER_M = 1000.0


@dataclass(frozen=True)
class HydraulicParams:
    """Run parameters; defaults are a sandy loam (Carsel and Parrish 1988)."""

    # Fixed values.
    texture: Column | str = "sandy loam"
    n: Column | float = 1.89
    theta_i: Column | float = 0.025
    theta_r: Column | float = 0.065
    theta_s: Column | float = 0.41
    radius_cm: Column | float = 2.25
    alpha_per_cm: Column | float = 0.075
    tension_cm: Column | float = -1.0


def coef_a1(p: HydraulicParams) -> Column:
    """Divisor of the sorptivity coefficient."""
    n, alpha = value(p.n), value(p.alpha_per_cm)
    water = F.pow(value(p.theta_s) - value(p.theta_i), F.lit(0.25))
    pressure = F.exp((n - 1.9) * 3.0 * alpha * value(p.tension_cm))
    size = F.pow(alpha * value(p.radius_cm), F.lit(0.15))
    return ratio(F.lit(1.4 * 0.55**0.5) * water * pressure, size)


def coef_a2(p: HydraulicParams) -> Column:
    """Divisor of the conductivity coefficient."""
    n, alpha = value(p.n), value(p.alpha_per_cm)
    rate = F.when(n >= 1.9, 2.92).otherwise(7.5)
    shape = (F.pow(n, F.lit(0.1)) - 1.0) * 11.65
    pressure = F.exp(rate * (n - 1.9) * alpha * value(p.tension_cm))
    size = F.pow(alpha * value(p.radius_cm), F.lit(0.91))
    return ratio(shape * pressure, size)


def sorptivity(c1: Column | str, a1: Column | str) -> Column:
    """Sorptivity in cm per root second."""
    return ratio(c1, a1)


def conductivity(c2: Column | str, a2: Column | str) -> Column:
    """Field-saturated conductivity in cm per second."""
    return ratio(c2, a2)


def sorptivity_per_hour(s_cm: Column | str) -> Column:
    """cm per root second to mm per root hour."""
    return col(s_cm) * (MM_PER_CM * ROOT_SECONDS_PER_ROOT_HOUR)


def conductivity_per_hour(k_cm: Column | str) -> Column:
    """cm per second to mm per hour."""
    return col(k_cm) * (MM_PER_CM * SECONDS_PER_HOUR)


def front_head(s_mm: Column | str, k_mm: Column | str, p: HydraulicParams) -> Column:
    """Wetting-front head in m from hourly sorptivity and conductivity."""
    storage = col(k_mm) * 2.0 * (value(p.theta_s) - value(p.theta_r))
    root = F.sqrt(F.when(storage > 0, storage))
    return finite(F.pow(ratio(s_mm, root), F.lit(2.0)) / MM_PER_M)
