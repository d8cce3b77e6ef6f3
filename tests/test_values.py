"""Cell expressions and single-frame operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from fieldsurvey.functions import values as v
from fieldsurvey.functions.hydrology import HydraulicParams
from fieldsurvey.operators import frames
from fieldsurvey.study import SEVERITY_BOUNDS, SEVERITY_ELSE, grade_default, grade_table


def cells(spark, inputs, kind, *exprs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    found = df.select("i", *[e.alias(f"o{n}") for n, e in enumerate(exprs)]).orderBy("i").collect()
    out = [tuple(r)[1:] for r in found]
    return [r[0] for r in out] if len(exprs) == 1 else out


def test_missing_tokens(spark):
    assert cells(spark, ["NA", "", "NaN", "a", None], "string", v.without_tokens("x")) == [None, None, "NaN", "a", None]


def test_numbers(spark):
    texts = ["1,234.5", "$-3 each", "2e3", ".5", "none", "", None, "7.", "1e999"]
    assert cells(spark, texts, "string", v.parse_number("x")) == [1234.5, -3.0, 2000.0, 0.5, None, None, None, 7.0, None]
    assert cells(spark, ["2", " 3.5 ", "NA", "1x", "-1", None], "string", v.to_number("x")) == [2.0, 3.5, None, None, -1.0, None]


def test_logicals_and_dates(spark):
    words = ["T", "true", "1", "F", "FALSE", "0", "yes", "", None]
    assert cells(spark, words, "string", v.parse_logical("x")) == [True, True, True, False, False, False, None, None, None]
    days = ["2020-07-13", " 2020-7-3", "2020-13-01", "13.07.2020", "2020", None]
    expected = [datetime.date(2020, 7, 13), datetime.date(2020, 7, 3), None, None, None, None]
    assert cells(spark, days, "string", v.parse_date("x")) == expected


def test_bands(spark):
    plots = [1.0, 3.0, 3.5, 4.0, 6.0, 7.0, 9.0, 10.0, None]
    labels = ["high", "high", "high", "moderate", "moderate", "low", "low", "unburned", None]
    assert cells(spark, plots, "double", v.band("x", SEVERITY_BOUNDS, SEVERITY_ELSE)) == labels


def test_flag_and_recode(spark):
    assert cells(spark, ["a", "no live", None], "string", v.flag(F.col("x") != "no live")) == [True, False, False]
    assert cells(spark, ["B", "Z", None], "string", v.recode("x", {"B": "bare"})) == ["bare", "Z", None]


def test_safe_ratio(spark):
    nan, inf = float("nan"), float("inf")
    assert cells(spark, [2.0, 0.0, nan, inf, None], "double", v.ratio(F.lit(1.0), "x")) == [0.5, None, None, 0.0, None]
    assert cells(spark, [1.0, nan, inf, -inf, None], "double", v.finite("x")) == [1.0, None, None, None, None]


@pytest.fixture
def replicates(spark):
    rows = [(0, 3.0, None, 1.0), (1, 5.0, 1.0, 2.0), (2, None, None, None), (3, None, 4.0, None)]
    return spark.createDataFrame(rows, "i int, a double, b double, c double")


def one(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_row_reductions(replicates):
    assert one(replicates, v.row_median("a", "b", "c")) == [2.0, 2.0, None, 4.0]
    assert one(replicates, v.row_median("a", "b", "c", mode="first")) == [3.0, 5.0, None, None]
    assert one(replicates, v.row_median("a", "b")) == [3.0, 3.0, None, 4.0]
    assert one(replicates, v.row_sum("a", "b", "c")) == [4.0, 8.0, 0.0, 4.0]
    assert one(replicates, v.row_mean("a", "b", "c")) == [2.0, 8.0 / 3, None, 4.0]
    with pytest.raises(ValueError):
        v.row_median("a", mode="last")


def test_mean_of_methods_keeps_zero(spark):
    rows = [(0, -0.2, 0.4, 0.6), (1, -1.0, -1.0, -1.0), (2, 0.0, None, 1.0)]
    df = frames.null_negative(spark.createDataFrame(rows, "i int, a double, b double, c double"), ["a", "b", "c"])
    assert one(df, v.row_mean("a", "b", "c")) == [0.5, None, 0.5]


def test_split_key(spark):
    df = spark.createDataFrame([("2_1",), ("2_NA_NA",), (None,), ("1_2_3_4",)], "k string")
    parts = frames.split_key(df, "k", ["p", "x", "y"]).collect()
    assert [tuple(r) for r in parts] == [
        ("2_1", "2", "1", None), ("2_NA_NA", "2", None, None), (None, None, None, None), ("1_2_3_4", "1", "2", "3"),
    ]
    dotted = spark.createDataFrame([("a.b",)], "k string")
    assert frames.split_key(dotted, "k", ["p", "q"], ".").first()[1:] == ("a", "b")


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (0, "x", None)], "n int, s string, t string")
    assert frames.relocate_first(df, ["t"]).columns == ["t", "n", "s"]
    assert [r.s for r in frames.fill_text(df, ["s"]).collect()] == ["", "x"]
    assert [r.n for r in frames.null_where(df, ["n"], lambda c: c == 0).collect()] == [1, None]
    row = frames.with_params(df, HydraulicParams()).first()
    assert (row.soil_texture_mdi, row.theta_s_cm3_cm3, row.tension_cm) == ("sandy loam", 0.41, -1.0)


def test_grades(spark):
    grades = grade_table(spark)
    assert grades.count() == 48
    counts = {c: dict(map(tuple, grades.groupBy(c).count().collect())) for c in ("ci_fit", "cl_fit", "dl_fit")}
    assert counts == {
        "ci_fit": {"good": 31, "moderate": 12, "poor": 5},
        "cl_fit": {"good": 28, "moderate": 8, "poor": 12},
        "dl_fit": {"good": 29, "moderate": 13, "poor": 6},
    }
    keys = spark.createDataFrame([("1_0_0", 1.0), ("10_2_8", 10.0), ("12_9_9", 12.0), (None, None)], "location_id string, plot_id double")
    found = frames.lookup(keys, grades, "location_id", grade_default()).orderBy("plot_id")
    assert [r.dl_fit for r in found.collect()] == [None, "good", "moderate", None]
    assert [r.ci_fit for r in found.collect()] == [None, "good", "poor", None]
