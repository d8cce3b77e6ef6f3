"""Curve fits and hydraulic properties on curves with known coefficients."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldsurvey.functions.aggregates import fit_line, fit_r2, fit_two_term, geomean, proportion
from fieldsurvey.functions.hydrology import HydraulicParams, coef_a1, coef_a2
from fieldsurvey.plans.infiltration import (
    coefficients_long,
    fit_methods,
    hydraulic_properties,
    infiltration_features,
    infiltration_fit,
    mean_estimates,
)
from fieldsurvey.study import FIT_EXPORT, export_names, grade_table

TIMES = [25.0, 49.0, 64.0, 100.0, 144.0, 225.0]
A1, A2 = 1.070446972390221, 3.8879818939846293


def curve(location, times=TIMES, c1=0.1, c2=0.01):
    return [(location, t, c1 * math.sqrt(t) + c2 * t) for t in times]


def frame(spark, rows):
    return spark.createDataFrame(rows, "location_id string, time_sec double, i_cm double")


def fits(spark, rows):
    found = fit_methods(infiltration_features(frame(spark, rows)))
    return {r.location_id: r.asDict() for r in found.collect()}


def test_exact_recovery(spark):
    fit = fits(spark, curve("a"))["a"]
    for method in ("ci", "cl"):
        assert fit[f"c1_{method}"] == pytest.approx(0.1, rel=1e-9)
        assert fit[f"c2_{method}"] == pytest.approx(0.01, rel=1e-9)
    assert fit["r2_cl"] == pytest.approx(1.0)


@pytest.mark.parametrize("start", [1, 1e3, 1e5, 1e6, 1e7])
def test_exact_recovery_of_a_late_series(spark, start):
    fit = fits(spark, curve("a", [float(start + s) for s in range(61)]))["a"]
    # From 1e6 s on, rounding of the readings themselves costs the first term some digits.
    assert fit["c1_ci"] == pytest.approx(0.1, rel=1e-8 if start < 1e6 else 1e-7)
    assert fit["c2_ci"] == pytest.approx(0.01, rel=1e-8)


def exact_two_term(points):
    """Least squares in whole fractions."""
    rows = [(Fraction(x), Fraction(y)) for x, y in points]
    s2, s3, s4 = (sum(x**n for x, _ in rows) for n in (2, 3, 4))
    xy, xxy = sum(x * y for x, y in rows), sum(x * x * y for x, y in rows)
    bottom = s2 * s4 - s3 * s3
    return float((s4 * xy - s3 * xxy) / bottom), float((s2 * xxy - s3 * xy) / bottom)


@pytest.mark.parametrize("start, digits", [(1, 1e-8), (1e4, 1e-8), (1e6, 1e-7), (1e9, 1e-3)])
@pytest.mark.parametrize("zeros", [0, 500])
def test_zeros_and_late_series_against_whole_fractions(spark, start, digits, zeros):
    r = random.Random(1)
    points = [(math.sqrt(start + s), 0.1 * math.sqrt(start + s) + 0.01 * (start + s)) for s in range(61)]
    points += [(0.0, r.random()) for _ in range(zeros)]
    c1, c2 = fit_two_term("x", "y")
    row = spark.createDataFrame(points, "x double, y double").agg(c1.alias("a"), c2.alias("b")).first()
    a, b = exact_two_term(points)
    assert row.b == pytest.approx(b, rel=min(digits, 1e-6)) and row.a == pytest.approx(a, rel=digits)


def test_a_fit_exists_where_x_varies(spark):
    points = [("close", 5.0, 1.0), ("close", 5.0 + 1e-7, 1.0 + 3e-7), ("zeros", 5.0 + 1e-7, 1.0 + 3e-7)]
    points += [("zeros", 0.0, 2.0)] * 1000 + [("zeros", 5.0, 1.0)] + [("one", 0.0, 3.0), ("one", 0.1, 1.0)]
    points += [("same", 0.1, float(n)) for n in range(7)] + [("only zeros", 0.0, 1.0)]
    c1, c2 = fit_two_term("x", "y")
    rows = spark.createDataFrame(points, "k string, x double, y double").groupBy("k").agg(c1.alias("a"), c2.alias("b")).collect()
    found = {r.k: (r.a, r.b) for r in rows}
    expected = exact_two_term([p[1:] for p in points if p[0] == "close"])
    assert found["close"] == pytest.approx(expected, rel=1e-5) and found["zeros"] == pytest.approx(expected, rel=1e-5)
    assert found["one"] == found["same"] == found["only zeros"] == (None, None)


def test_row_order_is_irrelevant(spark):
    rows = curve("a") + curve("b", c1=0.2)
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    a, b = fits(spark, rows), fits(spark, shuffled)
    for key in a:
        assert {k: pytest.approx(x, rel=1e-9) for k, x in a[key].items() if k != "location_id"} == {
            k: x for k, x in b[key].items() if k != "location_id"
        }


def test_zero_time(spark):
    plain, started = fits(spark, curve("a"))["a"], fits(spark, curve("a") + [("a", 0.0, 0.0)])["a"]
    assert started["c1_ci"] == pytest.approx(plain["c1_ci"])
    assert started["c1_cl"] == pytest.approx(plain["c1_cl"])
    assert started["r2_cl"] == pytest.approx(1.0)


def test_threshold_is_strict_and_r2_uses_all(spark):
    rows = curve("a") + [("a", 24.0, 50.0)]
    fit = fits(spark, rows)["a"]
    assert fit["c1_cl"] == pytest.approx(0.1)
    assert fit["r2_cl"] < 0.9
    filtered = fit_methods(infiltration_features(frame(spark, rows)), r2_filtered=True).first()
    assert filtered.r2_cl == pytest.approx(1.0)


def test_degenerate_groups(spark):
    rows = [("one", 30.0, 1.0), ("same", 36.0, 1.0), ("same", 36.0, 2.0), ("early", 4.0, 1.0), ("early", 9.0, 2.0)]
    rows += [("flat", t, 0.5 * math.sqrt(t)) for t in (25.0, 36.0, 49.0)]
    rows += [("nan", 30.0, None), ("neg", -4.0, 1.0), ("neg", -9.0, 1.0)]
    found = fits(spark, rows)
    assert all(x is None for k, x in found["one"].items() if k != "location_id")
    assert all(x is None for k, x in found["nan"].items() if k != "location_id")
    assert all(x is None for k, x in found["neg"].items() if k != "location_id")
    assert found["same"]["c1_ci"] is None and found["same"]["c1_dl"] is None
    assert found["early"]["c1_ci"] is not None and found["early"]["c1_cl"] is None
    assert found["flat"]["r2_cl"] is None and found["flat"]["c2_cl"] == pytest.approx(0.0, abs=1e-12)


def test_missing_values_leave_whole_rows_out(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 2.0), (2.0, 4.0, 6.0), (3.0, 9.0, 12.0), (None, 5.0, 99.0), (4.0, None, 99.0), (5.0, 25.0, None)],
        "x double, z double, y double",
    )
    c1, c2 = fit_two_term("x", "y")
    row = df.filter("z IS NOT NULL").agg(c1.alias("a"), c2.alias("b")).first()
    assert (row.a, row.b) == (pytest.approx(1.0), pytest.approx(1.0))
    c1, c2 = fit_line("y", "x", F.col("x") < 3)
    row = df.agg(c1.alias("a"), c2.alias("b"), fit_r2("y", "x").alias("r")).first()
    assert (row.a, row.b) == (pytest.approx(-2.0), pytest.approx(4.0))
    assert row.r == pytest.approx(0.6843477248923543)  # the row without z counts here


def test_long_form(spark):
    fit = fit_methods(infiltration_features(frame(spark, curve("a"))))
    long = coefficients_long(fit).filter("term = 'c1'")
    assert {r.method: r.estimate for r in long.collect()}["cl"] == pytest.approx(0.1)
    assert coefficients_long(fit).count() == 6


def test_scaling(spark):
    params = HydraulicParams()
    rows = spark.createDataFrame([(0.1, 0.01), (0.1, 0.0), (None, 0.01)], "c1 double, c2 double")
    assert rows.select(coef_a1(params)).first()[0] == pytest.approx(A1, rel=1e-12)
    assert rows.select(coef_a2(params)).first()[0] == pytest.approx(A2, rel=1e-12)
    full, no_flow, no_c1 = hydraulic_properties(rows, params).collect()
    s, k = 600 * 0.1 / A1, 36000 * 0.01 / A2
    assert full.s_mm_hr0_5 == pytest.approx(s) and full.kfs_mm_hr == pytest.approx(k)
    assert full.hf_m == pytest.approx((s / math.sqrt(2 * k * (0.41 - 0.065))) ** 2 / 1000)
    assert no_flow.kfs_mm_hr == 0 and no_flow.hf_m is None
    assert no_c1.s_mm_hr0_5 is None and no_c1.hf_m is None


def test_wide_pores_divide_once(spark):
    params = HydraulicParams(n=2.28, alpha_per_cm=0.124)
    size = (0.124 * 2.25) ** 0.91
    expected = 11.65 * (2.28**0.1 - 1) * math.exp(2.92 * (2.28 - 1.9) * 0.124 * -1) / size
    assert spark.range(1).select(coef_a2(params)).first()[0] == pytest.approx(expected, rel=1e-12)


def test_all_second_estimates_missing(spark):
    table = "location_id string, c1_ci double, c2_ci double, c1_cl double, c2_cl double, c1_dl double, c2_dl double"
    fit = spark.createDataFrame([("a", -0.2, -1.0, 0.4, -1.0, 0.6, -2.0)], table)
    row = mean_estimates(fit).first()
    assert row.c1 == pytest.approx(0.5) and row.c2 is None


def test_fit_table(spark):
    rows = curve("2_10_0") + curve("10_2_8") + curve("12_NA_NA")
    table = infiltration_fit(frame(spark, rows), grades=grade_table(spark))
    assert sorted(table.columns) == sorted(export_names(FIT_EXPORT)) and len(table.columns) == 32
    assert table.columns == list(export_names(FIT_EXPORT))
    found = {r.location_id: r for r in table.collect()}
    assert (found["2_10_0"].plot_id, found["2_10_0"].x_m, found["2_10_0"].burn_severity) == (2.0, 10.0, "high")
    assert found["2_10_0"].ci_fit == "good" and found["10_2_8"].dl_fit == "moderate"
    assert found["12_NA_NA"].x_m is None and found["12_NA_NA"].cl_fit is None
    assert found["12_NA_NA"].burn_severity == "unburned"


def test_heavy_location_gives_same_fits(spark):
    rows = curve("1_0_0", [float(t) for t in range(1, 400)]) + curve("1_0_1") + curve("1_1_0", c1=0.3)
    plain = infiltration_fit(frame(spark, rows), max_rows=None)
    cut = infiltration_fit(frame(spark, rows), max_rows=25)
    for a, b in zip(plain.orderBy("location_id").collect(), cut.orderBy("location_id").collect()):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, rel=1e-9) if isinstance(x, float) else y)


def test_group_summaries(spark):
    rows = [("a", 1.0), ("a", 4.0), ("b", 1.0), ("b", 0.0), ("b", 4.0), ("c", 2.0), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    found = df.groupBy("k").agg(geomean("x").alias("g"), proportion(F.col("x") > 1).alias("p")).orderBy("k")
    assert [tuple(r) for r in found.collect()] == [
        ("a", pytest.approx(2.0), 0.5), ("b", None, pytest.approx(1 / 3)), ("c", pytest.approx(2.0), 1.0), ("d", None, None),
    ]
