"""Shape of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from fieldsurvey.checks import QUERIES
from fieldsurvey.checks.views import table
from fieldsurvey.plans.site import site_merge


@pytest.fixture
def plan(spark, sf_dir):
    def of(name):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    return of


def exchanges(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_workers_and_no_cross_products(plan, name):
    text = plan(name)
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInArrow"):
        assert word not in text


@pytest.mark.parametrize("name", ["infiltration_fit", "fit_dl", "mean_of_methods", "lead_diff"])
def test_fit_has_one_shuffle(plan, name):
    text = plan(name)
    assert exchanges(text) == 1
    assert text.count("Sort [") == 1


@pytest.mark.parametrize(
    "name", ["ground_cover", "canopy_cover", "canopy_totals", "overstory_cover", "overstory_total", "group_means"]
)
def test_cover_has_one_shuffle_and_hash_aggregates(plan, name):
    text = plan(name)
    assert exchanges(text) == 1 and "SortAggregate" not in text


def test_summary_shuffles_only_group_rows(plan):
    text = plan("plot_summary")
    assert "SortAggregate" not in text
    assert exchanges(text) == 2  # partial groups, then the check of one row per plot


def test_unique_merge_adds_no_shuffle(plan):
    """Four sources, each shuffled once for its own aggregation; no join."""
    text = plan("merge_many")
    assert exchanges(text) == 4 and "Join" not in text


@pytest.mark.parametrize("name", ["share_of_first_layer", "layer_counts"])
def test_layers_are_counted_in_one_scan(plan, name):
    text = plan(name)
    assert text.count("FileScan") == 1 and "Join" not in text


def test_lookup_broadcasts_the_small_table(plan):
    text = plan("quality_lookup")
    assert "BroadcastHashJoin" in text and exchanges(text) == 0


def test_columns_and_filters_reach_the_scan(plan, spark, sf_dir):
    text = plan("equal_filter")
    assert "value" not in text.split("ReadSchema")[1]
    assert "PushedFilters: [" in text and "event_type" in text.split("PushedFilters")[1]
    assert len(table(spark, sf_dir, "events").columns) == 6


def test_fanout_merge_shuffles_each_side_once(plan):
    assert exchanges(plan("merge_fanout")) == 2


def test_site_merge_keeps_the_survey_in_place(spark):
    """Raw survey rows meet the measured sources by broadcast; only distinct keys are shuffled."""
    survey = spark.range(5000).select(F.concat_ws("_", F.col("id") % 9, F.lit(0), F.lit(0)).alias("location_id"), F.lit("G").alias("lf1"))
    small = [
        spark.range(5).select(F.concat_ws("_", F.col("id"), F.lit(0), F.lit(0)).alias("location_id"), F.lit(1.0).alias(c))
        for c in ("s_mm_hr0_5", "bulk_density_gcm3", "sand_percent")
    ]
    merged = site_merge(survey, *small, max_rows=None)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert exchanges(text) == 1 and "lf1" not in text.split("Exchange hashpartitioning")[1]


def test_summary_methods_stay_small_enough_to_compile(spark, sf_dir):
    """Above 8,000 bytes the JVM interprets a generated method."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        executed = QUERIES["plot_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(executed)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8_000
