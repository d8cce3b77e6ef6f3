"""The three runs in sequence over stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsurvey.checks.covers import MEAN_NAMES, SHARE_NAMES, rounded_summary_sql, summary_sql
from fieldsurvey.checks.fits import FIT_TABLE_SQL, ORDER
from fieldsurvey.checks.registry import query, round_all
from fieldsurvey.checks.views import POINTS_SQL, location_key, location_key_sql, readings, survey_points, table
from fieldsurvey.plans.staged import run_stages
from fieldsurvey.scratch import new_table_path

SOURCES_SQL = f"""
by_location AS (SELECT {location_key_sql("user_id")} AS location_id, event_type, value FROM events),
shifted AS (SELECT {location_key_sql("(user_id + 15)")} AS location_id, event_type, value FROM events),
density AS (SELECT location_id, max(value) / 100 AS bulk_density_gcm3 FROM by_location
  WHERE event_type = 'purchase' GROUP BY location_id),
soil AS (SELECT location_id, max(value) AS sand_percent, min(value) AS silt_percent, max(value) / 9 AS clay_percent,
    max(value) / 7 AS total_organic_carbon_percent, max(value) / 90 AS total_nitrogen_percent
  FROM shifted WHERE event_type = 'error' GROUP BY location_id)"""


def stage_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    keyed = table(spark, sf_dir, "events").withColumn("location_id", location_key("user_id"))
    shifted = table(spark, sf_dir, "events").withColumn("location_id", location_key(F.col("user_id") + 15))
    peak = F.max("value")
    density = keyed.filter(F.col("event_type") == "purchase").groupBy("location_id")
    soil = shifted.filter(F.col("event_type") == "error").groupBy("location_id")
    return {
        "readings": readings(spark, sf_dir, location_key("user_id")),
        "survey": survey_points(spark, sf_dir),
        "density": density.agg((peak / 100).alias("bulk_density_gcm3")),
        "soil": soil.agg(
            peak.alias("sand_percent"),
            F.min("value").alias("silt_percent"),
            (peak / 9).alias("clay_percent"),
            (peak / 7).alias("total_organic_carbon_percent"),
            (peak / 90).alias("total_nitrogen_percent"),
        ),
    }


@query(f"""WITH {FIT_TABLE_SQL}, {POINTS_SQL}, {SOURCES_SQL},
merged AS (SELECT * EXCLUDE (plot_id, x_m, y_m, burn_severity), split_part(location_id, '_', 1)::DOUBLE AS plot_id
  FROM points FULL JOIN fit_table USING (location_id) FULL JOIN density USING (location_id) FULL JOIN soil USING (location_id)),
{summary_sql("merged")}
{rounded_summary_sql(MEAN_NAMES + SHARE_NAMES, "summary")}""")
def staged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings to fits, merged site table and plot summary, each kept as a table."""
    tables = run_stages(stage_sources(spark, sf_dir), new_table_path(spark, "stages"), order=ORDER)
    return round_all(tables["plot_summary"])
