"""Infiltration fits, window features and hydraulic properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsurvey.checks.registry import query, round_all, rounded_sql
from fieldsurvey.checks.views import (
    SEVERITY_CASE,
    location_key,
    location_key_sql,
    readings,
    readings_sql,
    table,
)
from fieldsurvey.functions.aggregates import fit_two_term
from fieldsurvey.functions.hydrology import HydraulicParams
from fieldsurvey.operators.groups import quality_sensitivity as sensitivity
from fieldsurvey.plans.infiltration import (
    ESTIMATES,
    coefficients_long,
    fit_ci as ci_columns,
    fit_cl as cl_columns,
    fit_dl as dl_columns,
    fit_methods,
    hydraulic_properties,
    infiltration_features,
    infiltration_fit as infiltration_fit_plan,
    mean_estimates,
    root_features,
)
from fieldsurvey.study import FIT_GRADES, grade_table

# The order of elapsed time, in the columns the readings are already sorted by.
ORDER = ["ts", "event_id"]

FEATURES_SQL = """
rooted AS (
  SELECT *, sqrt(time_sec) AS sqrt_time,
         CASE WHEN time_sec > 0 THEN i_cm / sqrt(time_sec) END AS i_per_sqrt_time
  FROM readings),
paired AS (
  SELECT *, lead(sqrt_time) OVER w AS next_root, lead(i_cm) OVER w AS next_i
  FROM rooted WINDOW w AS (PARTITION BY location_id ORDER BY time_sec, event_id)),
features AS (
  SELECT location_id, event_id, time_sec, i_cm, sqrt_time, i_per_sqrt_time,
         sqrt(sqrt_time * next_root) AS geomean_sqrt_time,
         CASE WHEN next_root <> sqrt_time THEN (next_i - i_cm) / (next_root - sqrt_time) END AS di_dsqrt_time
  FROM paired)"""


def _line_sql(y: str, x: str, suffix: str, late: str, halve: bool) -> str:
    half = " / 2" if halve else ""
    keep = f"{y} IS NOT NULL AND {x} IS NOT NULL"
    return f"""
         CASE WHEN count(*) FILTER ({late} AND {keep}) > 1
              THEN regr_intercept({y}, {x}) FILTER ({late}) END AS c1_{suffix},
         CASE WHEN count(*) FILTER ({late} AND {keep}) > 1
              THEN regr_slope({y}, {x}) FILTER ({late}){half} END AS c2_{suffix},
         CASE WHEN min({y}) FILTER ({keep}) < max({y}) FILTER ({keep})
              THEN regr_r2({y}, {x}) END AS r2_{suffix}"""


FITS_SQL = f"""
weighted AS (
  SELECT *, sum(time_sec * sqrt_time) OVER l / nullif(sum(time_sec) OVER l, 0) AS mean_root,
         sum(i_cm * sqrt_time) OVER l / nullif(sum(time_sec) OVER l, 0) AS mean_rate
  FROM features WINDOW l AS (PARTITION BY location_id)),
sums AS (
  SELECT location_id, any_value(mean_root) AS mean_root, any_value(mean_rate) AS mean_rate,
         sum(time_sec * pow(sqrt_time - mean_root, 2)) AS spread,
         sum(time_sec * (sqrt_time - mean_root) * (coalesce(i_per_sqrt_time, 0) - mean_rate)) AS shared,
         min(sqrt_time) FILTER (sqrt_time > 0) < max(sqrt_time) AS varied,
{_line_sql("i_per_sqrt_time", "sqrt_time", "cl", "time_sec > 24", False)},
{_line_sql("di_dsqrt_time", "geomean_sqrt_time", "dl", "true", True)}
  FROM weighted GROUP BY location_id),
fits AS (
  SELECT location_id,
         CASE WHEN varied THEN mean_rate - mean_root * shared / spread END AS c1_ci,
         CASE WHEN varied THEN shared / spread END AS c2_ci,
         c1_cl, c2_cl, r2_cl, c1_dl, c2_dl, r2_dl
  FROM sums)"""

_VALID = ",\n".join(f"         CASE WHEN {c} >= 0 THEN {c} END AS {c}" for c in ESTIMATES)


def _mean_sql(term: str) -> str:
    cells = [f"{term}_{m}" for m in ("ci", "cl", "dl")]
    total = " + ".join(f"coalesce({c}, 0)" for c in cells)
    present = " + ".join(f"({c} IS NOT NULL)::INT" for c in cells)
    return f"({total}) / nullif({present}, 0) AS {term}"


MEANS_SQL = f"""
valid AS (
  SELECT location_id, r2_cl, r2_dl,
{_VALID}
  FROM fits),
means AS (SELECT *, {_mean_sql("c1")}, {_mean_sql("c2")} FROM valid)"""


def hydraulics_sql(source: str, name: str, n: str, theta_i: str, theta_r: str, theta_s: str,
                   radius: str, alpha: str, tension: str) -> str:
    """CTEs from rows with c1, c2 to hydraulic properties."""
    return f"""
{name}_a AS (
  SELECT *,
         (1.4 * sqrt(0.55)) * pow({theta_s} - {theta_i}, 0.25)
           * exp(3 * ({n} - 1.9::DOUBLE) * {alpha} * {tension}) / pow({alpha} * {radius}, 0.15) AS a1,
         11.65 * (pow({n}, 0.1) - 1)
           * exp((CASE WHEN {n} >= 1.9 THEN 2.92 ELSE 7.5 END) * ({n} - 1.9::DOUBLE) * {alpha} * {tension})
           / pow({alpha} * {radius}, 0.91) AS a2
  FROM {source}),
{name}_b AS (SELECT *, c1 / a1 AS s_cm_sec0_5, c2 / a2 AS kfs_cm_sec FROM {name}_a),
{name}_c AS (SELECT *, s_cm_sec0_5 * 600 AS s_mm_hr0_5, kfs_cm_sec * 36000 AS kfs_mm_hr FROM {name}_b),
{name} AS (
  SELECT *, CASE WHEN kfs_mm_hr * 2 * ({theta_s} - {theta_r}) > 0
                 THEN pow(s_mm_hr0_5 / sqrt(kfs_mm_hr * 2 * ({theta_s} - {theta_r})), 2) / 1000 END AS hf_m
  FROM {name}_c)"""


_GRADE_ROWS = ",\n    ".join(
    "({})".format(", ".join(f"'{word}'" for word in line.split())) for line in FIT_GRADES.strip().splitlines()
)
GRADES_SQL = f"""
grades(location_id, ci_fit, cl_fit, dl_fit) AS (VALUES
    {_GRADE_ROWS})"""

FIT_TABLE_SQL = f"""{readings_sql(location_key_sql("user_id"))},
{FEATURES_SQL},
{FITS_SQL},
{MEANS_SQL},
{hydraulics_sql("means", "hydro", "1.89::DOUBLE", "0.025::DOUBLE", "0.065::DOUBLE", "0.41::DOUBLE",
                "2.25::DOUBLE", "0.075::DOUBLE", "-1::DOUBLE")},
{GRADES_SQL},
sited AS (
  SELECT *, split_part(location_id, '_', 1)::DOUBLE AS plot_id, split_part(location_id, '_', 2)::DOUBLE AS x_m,
         split_part(location_id, '_', 3)::DOUBLE AS y_m
  FROM hydro),
fit_table AS (
  SELECT s.*, {SEVERITY_CASE.format("plot_id")} AS burn_severity,
         CASE WHEN plot_id < 10 THEN 'good' ELSE g.ci_fit END AS ci_fit,
         CASE WHEN plot_id < 10 THEN 'good' ELSE g.cl_fit END AS cl_fit,
         CASE WHEN plot_id < 10 THEN 'good' ELSE g.dl_fit END AS dl_fit
  FROM sited s LEFT JOIN grades g USING (location_id))"""


def _rounded_list(*names: str) -> str:
    return ", ".join(f"{rounded_sql(c)} AS {c}" for c in names)


@query(f"""WITH {readings_sql()}, {FEATURES_SQL}
SELECT location_id, event_id, {_rounded_list("time_sec", "i_cm", "sqrt_time", "i_per_sqrt_time",
"geomean_sqrt_time", "di_dsqrt_time")} FROM features""")
def lead_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(infiltration_features(readings(spark, sf_dir), order=ORDER, max_rows=None).drop("ts"))


@query(f"""WITH {readings_sql()}, {FEATURES_SQL}, {FITS_SQL}
SELECT location_id, {_rounded_list("c1_ci", "c2_ci")} FROM fits""")
def fit_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(root_features(readings(spark, sf_dir)).groupBy("location_id").agg(*ci_columns()))


@query(f"""WITH {readings_sql()}, {FEATURES_SQL}, {FITS_SQL}
SELECT location_id, {_rounded_list("c1_cl", "c2_cl", "r2_cl")} FROM fits""")
def fit_cl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(root_features(readings(spark, sf_dir)).groupBy("location_id").agg(*cl_columns()))


@query(f"""WITH {readings_sql()}, {FEATURES_SQL}, {FITS_SQL}
SELECT location_id, {_rounded_list("c1_dl", "c2_dl", "r2_dl")} FROM fits""")
def fit_dl(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = infiltration_features(readings(spark, sf_dir), order=ORDER, max_rows=None)
    return round_all(features.groupBy("location_id").agg(*dl_columns()))


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_methods(infiltration_features(readings(spark, sf_dir), order=ORDER, max_rows=None))


_LONG_SQL = " UNION ALL ".join(
    f"SELECT location_id, '{c[3:]}' AS method, '{c[:2]}' AS term, {rounded_sql(c)} AS estimate FROM fits"
    for c in ESTIMATES
)


@query(f"WITH {readings_sql()}, {FEATURES_SQL}, {FITS_SQL} {_LONG_SQL}")
def fit_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(coefficients_long(_fits(spark, sf_dir)))


@query(f"""WITH {readings_sql()}, {FEATURES_SQL}, {FITS_SQL}, {MEANS_SQL}
SELECT location_id, {_rounded_list(*ESTIMATES, "c1", "c2")} FROM means""")
def mean_of_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(mean_estimates(_fits(spark, sf_dir)).drop("r2_cl", "r2_dl"))


_PART_PARAMS_SQL = """
parts AS (
  SELECT p_partkey, 1.3::DOUBLE + p_size / 40::DOUBLE AS n, 0.01::DOUBLE + p_size / 1000::DOUBLE AS theta_i,
         p_retailprice / 10000::DOUBLE AS c1, (p_partkey % 97) / 1000::DOUBLE AS c2
  FROM part)"""


@query(f"""WITH {_PART_PARAMS_SQL},
{hydraulics_sql("parts", "hydro", "n", "theta_i", "0.065::DOUBLE", "0.41::DOUBLE", "2.25::DOUBLE",
                "0.075::DOUBLE", "-1::DOUBLE")}
SELECT p_partkey, {_rounded_list("n", "a1", "a2", "s_mm_hr0_5", "kfs_mm_hr", "hf_m")} FROM hydro""")
def hydraulic_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that differ by row, on both sides of the pore-size threshold."""
    size = F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.lit(1.3) + size / F.lit(40.0)).alias("n"),
        (F.lit(0.01) + size / F.lit(1000.0)).alias("theta_i"),
        (F.col("p_retailprice") / F.lit(10000.0)).alias("c1"),
        ((F.col("p_partkey") % 97).cast("double") / F.lit(1000.0)).alias("c2"),
    )
    params = HydraulicParams(n=F.col("n"), theta_i=F.col("theta_i"))
    found = hydraulic_properties(rows, params)
    return round_all(found.select("p_partkey", "n", "a1", "a2", "s_mm_hr0_5", "kfs_mm_hr", "hf_m"))


def fit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = readings(spark, sf_dir, location_key("user_id"))
    return infiltration_fit_plan(keyed, grades=grade_table(spark), order=ORDER, max_rows=None)


@query(f"""WITH {FIT_TABLE_SQL}
SELECT location_id, plot_id, x_m, y_m, burn_severity, {rounded_sql("hf_m", 5)} AS hf_m,
  {rounded_sql("kfs_cm_sec", 10)} AS kfs_cm_sec, {rounded_sql("c2_cl", 9)} AS c2_cl, {rounded_sql("c2", 9)} AS c2,
  {_rounded_list("s_mm_hr0_5", "kfs_mm_hr", "c1_ci", "c2_ci", "c1_cl", "r2_cl", "c1_dl", "c2_dl", "r2_dl", "a1", "a2", "c1", "s_cm_sec0_5")},
  'sandy loam' AS soil_texture_mdi, 1.89::DOUBLE AS n, 0.025::DOUBLE AS theta_i_cm3_cm3,
  0.41::DOUBLE AS theta_s_cm3_cm3, 2.25::DOUBLE AS mdiradius_cm, 0.075::DOUBLE AS alpha_percm,
  -1::DOUBLE AS tension_cm, ci_fit, cl_fit, dl_fit
FROM fit_table""")
def infiltration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(fit_table(spark, sf_dir), hf_m=5, kfs_cm_sec=10, c2_cl=9, c2=9)


def _variant_sql(name: str, where: str) -> str:
    return f"""SELECT burn_severity, '{name}' AS variant, {rounded_sql("avg(c1_ci)")} AS mean_c1_ci,
  {rounded_sql("avg(c2_ci)")} AS mean_c2_ci FROM fit_table WHERE {where} GROUP BY burn_severity"""


@query(f"""WITH {FIT_TABLE_SQL}
{_variant_sql("drop_poor", "ci_fit <> 'poor'")} UNION ALL
{_variant_sql("keep_all", "true")} UNION ALL
{_variant_sql("only_good", "ci_fit = 'good'")}""")
def quality_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = fit_table(spark, sf_dir)
    return round_all(sensitivity(graded, "burn_severity", ["c1_ci", "c2_ci"], "ci_fit"))


def _missing_user_sql() -> str:
    return readings_sql("CASE WHEN user_id % 2 = 1 THEN user_id END")


@query(f"""WITH {_missing_user_sql()}
SELECT location_id, event_id, {_rounded_list("time_sec", "i_cm")} FROM readings""")
def readings_missing_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the locations are missing and are one series together."""
    key = F.when(F.col("user_id") % 2 == 1, F.col("user_id"))
    return round_all(readings(spark, sf_dir, key).select("location_id", "event_id", "time_sec", "i_cm"))


_OFFSET = 1_000_000


@query(f"""WITH late AS (
  SELECT user_id AS location_id, sqrt({_OFFSET} + epoch(ts) % 3600) AS x, 0.1 AS c1, 0.01 AS c2 FROM events),
series AS (SELECT location_id, x, c1 * x + c2 * x * x AS y FROM late),
means AS (SELECT *, sum(x * x * x) OVER w / sum(x * x) OVER w AS mx, sum(x * y) OVER w / sum(x * x) OVER w AS my
  FROM series WINDOW w AS (PARTITION BY location_id)),
fitted AS (SELECT location_id, any_value(mx) AS mx, any_value(my) AS my, min(x) < max(x) AS varied,
    sum(x * x * (x - mx) * (y / x - my)) / sum(x * x * (x - mx) * (x - mx)) AS slope FROM means GROUP BY location_id)
SELECT location_id, {rounded_sql("CASE WHEN varied THEN my - slope * mx END", 5)} AS c1,
  {rounded_sql("CASE WHEN varied THEN slope END", 8)} AS c2 FROM fitted""")
def fit_ci_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that begin late: the spread of time is small against time itself."""
    x = F.sqrt((F.lit(_OFFSET) + F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 % 3600).cast("double"))
    late = table(spark, sf_dir, "events").select(F.col("user_id").alias("location_id"), x.alias("x"))
    series = late.withColumn("y", F.lit(0.1) * F.col("x") + F.lit(0.01) * F.col("x") * F.col("x"))
    c1, c2 = fit_two_term("x", "y")
    return round_all(series.groupBy("location_id").agg(c1.alias("c1"), c2.alias("c2")), 8, c1=5)
