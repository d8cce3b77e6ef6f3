"""Neighbouring rows, with and without heavy groups."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldsurvey.checks import views
from fieldsurvey.checks.fits import ORDER
from fieldsurvey.operators.ordered import (
    SLICE,
    finite_diff,
    neighbour_geomean,
    next_value,
    ordered_scan,
    share_of_base,
    share_of_group,
    slice_heavy_groups,
    with_next,
    with_share,
)
from fieldsurvey.plans.infiltration import infiltration_features


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; another is missing; times repeat."""
    n = F.col("id")
    key = F.when(n % 3 == 0, "hot").when(n % 31 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), n % 40))
    return spark.range(6000).select(
        key.alias("k"), (F.hash(n) % 500).alias("t"), n.alias("tie"), F.when(n % 7 != 0, n * 3).alias("v")
    )


def rows(df, *cols):
    return sorted(map(repr, df.select(*cols).collect()))


def test_next_across_slices(skewed):
    order = ["t", "tie"]
    plain = with_next(skewed, ["k"], order, ["v", "t"])
    cut = slice_heavy_groups(skewed, ["k"], order, max_rows=120)
    assert SLICE in cut.columns
    assert cut.filter(f"{SLICE} > 0").select("k").distinct().count() == 2  # the hot key and the missing one
    assert cut.filter("k = 'hot'").select(SLICE).distinct().count() > 5
    assert cut.groupBy("k", SLICE).count().agg(F.max("count")).first()[0] < 1000
    names = ["k", "t", "tie", "v", "next_v", "next_t"]
    assert rows(with_next(cut, ["k"], order, ["v", "t"]), *names) == rows(plain, *names)


def test_schema_does_not_depend_on_heavy_groups(skewed):
    whole = slice_heavy_groups(skewed, ["k"], ["t", "tie"], max_rows=10_000)
    cut = slice_heavy_groups(skewed, ["k"], ["t", "tie"], max_rows=120)
    assert whole.dtypes == cut.dtypes
    assert whole.filter(f"{SLICE} <> 0").isEmpty()


def test_missing_location_is_one_series_in_slices(spark, sf_dir, monkeypatch):
    """Half of the locations are missing; their running total goes on from slice to slice."""
    key = F.when(F.col("user_id") % 2 == 1, F.col("user_id"))
    names = ["location_id", "event_id", "time_sec", "i_cm"]
    plain = rows(views.readings(spark, sf_dir, key), *names)
    monkeypatch.setattr(views, "slice_heavy_groups", lambda df, by, order: slice_heavy_groups(df, by, order, max_rows=70))
    cut = views.readings(spark, sf_dir, key)
    assert cut.filter("location_id IS NULL").select(SLICE).distinct().count() > 5
    assert rows(cut, *names) == plain


def test_column_builders_agree_with_frames(skewed):
    order = ["t", "tie"]
    a = skewed.select("tie", next_value("t", ["k"], order).alias("next_t"))
    b = with_next(skewed, ["k"], order, ["t"])
    assert rows(a, "tie", "next_t") == rows(b, "tie", "next_t")


def test_equal_values_give_no_slope(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 4.0, 9.0)], "k int, x double, y double")
    order = ["x", "y"]
    found = df.select(
        "y", finite_diff("y", "x", ["k"], order).alias("d"), neighbour_geomean("x", ["k"], order).alias("g")
    ).orderBy("y")
    assert [tuple(r) for r in found.collect()] == [(2.0, None, 1.0), (3.0, 2.0, 2.0), (9.0, None, None)]


def test_readings_and_features_do_not_depend_on_slicing(spark, sf_dir, monkeypatch):
    names = ["location_id", "event_id", "time_sec", "i_cm", "geomean_sqrt_time", "di_dsqrt_time"]
    plain = rows(infiltration_features(views.readings(spark, sf_dir), order=ORDER, max_rows=None), *names)

    def small(df, by, order):
        return slice_heavy_groups(df, by, order, max_rows=70)

    monkeypatch.setattr(views, "slice_heavy_groups", small)
    sliced = views.readings(spark, sf_dir)
    assert SLICE in sliced.columns
    assert rows(infiltration_features(sliced, order=ORDER), *names) == plain
    again = infiltration_features(views.readings(spark, sf_dir).drop(SLICE), order=ORDER, max_rows=60)
    assert rows(again, *names) == plain


def test_shares(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 3, 2), ("b", 0, None)], "k string, n int, m int")
    found = df.select("k", "n", share_of_group("n", ["k"]).alias("s"), share_of_base("n", "m", ["k"]).alias("b"))
    assert sorted(map(tuple, found.collect())) == [("a", 1, 0.25, 0.5), ("a", 3, 0.75, 1.5), ("b", 0, None, None)]


RUNNING = {"total": ("sum", "v"), "seen": ("count", "v"), "low": ("min", "v"), "high": ("max", "t")}


def test_scan_does_not_depend_on_slices(skewed):
    order = ["t", "tie"]
    names = ["k", "tie", *RUNNING, "next_v"]
    window = Window.partitionBy("k").orderBy(*order)
    up_to = window.rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.withColumns(
        {"total": F.sum("v").over(up_to), "seen": F.count("v").over(up_to), "low": F.min("v").over(up_to), "high": F.max("t").over(up_to),
         "next_v": F.lead("v").over(window)}
    )
    for max_rows in (None, 70, 120):
        found = ordered_scan(skewed, ["k"], order, RUNNING, ["v"], max_rows=max_rows)
        assert SLICE not in found.columns and rows(found, *names) == rows(plain, *names)
    # A frame that is cut already stays so.
    cut = slice_heavy_groups(skewed, ["k"], order, max_rows=70)
    assert SLICE in ordered_scan(cut, ["k"], order, RUNNING).columns


def test_scan_over_missing_cells_and_no_rows(spark):
    df = spark.range(60).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("t"), F.when(F.col("id") > 25, F.col("id")).alias("v"))
    found = ordered_scan(df, ["k"], ["t"], RUNNING | {"high": ("max", "v")}, max_rows=10)
    for r in found.collect():
        seen = [v for v in range(26, r.t + 1)]
        assert (r.total, r.seen, r.low, r.high) == (sum(seen) if seen else None, len(seen), min(seen, default=None), max(seen, default=None))
    assert ordered_scan(df.limit(0), ["k"], ["t"], RUNNING, ["v"]).count() == 0


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "max_rows": None}, {"broadcast_rows": 2, "max_rows": 150}, {"broadcast_rows": 0, "max_rows": 150}])
def test_shares_of_raw_rows(skewed, options):
    plain = skewed.select("k", "tie", share_of_group("v", ["k"]).alias("s"), share_of_base("t", "v", ["k"]).alias("b"))
    found = with_share(with_share(skewed, "v", ["k"], name="s", **options), "t", ["k"], "v", "b", **options)
    assert rows(found, "k", "tie", "s", "b") == rows(plain, "k", "tie", "s", "b")


def test_shares_move_no_rows_where_totals_are_few(skewed, spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = with_share(skewed, "v", ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "Window" not in text
