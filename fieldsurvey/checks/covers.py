"""Cover shares and plot means; the SQL counts, joins and divides step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsurvey.checks.registry import query, round_all, rounded_sql
from fieldsurvey.checks.views import POINTS_SQL, SEVERITY_CASE, SURVEY_SQL, survey, survey_points
from fieldsurvey.functions.values import band
from fieldsurvey.operators.cover import canopy_totals as canopy_totals_of
from fieldsurvey.operators.cover import overstory_total as overstory_total_of
from fieldsurvey.operators.cover import single_layer_cover, two_layer_cover
from fieldsurvey.plans.site import plot_means as plot_means_of
from fieldsurvey.plans.site import plot_summary as plot_summary_of
from fieldsurvey.study import (
    CANOPY_CODES,
    FOLIAR_CODES,
    GROUND_CODES,
    GROUND_TOTALS,
    OVERSTORY_ABSENT,
    OVERSTORY_CODES,
    SEVERITY_BOUNDS,
    SEVERITY_ELSE,
)

SURVEYED_SQL = f"{SURVEY_SQL}, surveyed AS (SELECT * FROM survey WHERE ground_cover IS NOT NULL)"
KINDS = {k: f"kind_{k}_prop" for k in ("click", "purchase", "signup", "view")}
KIND_TOTALS = {"kind_active_prop": ["kind_click_prop", "kind_view_prop"]}


def single_layer_sql(source: str, code: str, mapping: dict, totals: dict) -> str:
    """CTEs ``ground_n``, ``ground_s`` and ``ground``: count, share, pivot, sums."""
    cells = ", ".join(
        f"coalesce(max(share) FILTER ({code} = '{k}'), 0) AS {name}" for k, name in sorted(mapping.items(), key=lambda m: m[1])
    )
    sums = ", ".join(f"{' + '.join(parts)} AS {name}" for name, parts in totals.items())
    return f"""
ground_n AS (SELECT plot_id, {code}, count(*) AS n FROM {source} GROUP BY ALL),
ground_s AS (SELECT *, n / sum(n) OVER (PARTITION BY plot_id)::DOUBLE AS share FROM ground_n),
ground_w AS (SELECT plot_id, {cells} FROM ground_s GROUP BY plot_id),
ground AS (SELECT *, {sums} FROM ground_w)"""


def two_layer_sql(source: str, name: str, l1: str, l2: str, mapping: dict, drop_first: bool) -> str:
    """CTEs for two layers: counts, null-safe join, share, pivot."""
    early = "WHERE cover IS NOT NULL" if drop_first else ""
    cells = ", ".join(
        f"coalesce(max(share) FILTER (cover = '{k}'), 0) AS {col}" for k, col in sorted(mapping.items(), key=lambda m: m[1])
    )
    return f"""
{name}_1 AS (SELECT plot_id, {l1} AS cover, count(*) AS n1 FROM {source} GROUP BY ALL),
{name}_2 AS (SELECT plot_id, {l2} AS cover, count(*) AS n2 FROM {source} GROUP BY ALL),
{name}_j AS (
  SELECT coalesce(a.plot_id, b.plot_id) AS plot_id, coalesce(a.cover, b.cover) AS cover, n1, n2
  FROM {name}_1 a FULL JOIN {name}_2 b
    ON a.plot_id IS NOT DISTINCT FROM b.plot_id AND a.cover IS NOT DISTINCT FROM b.cover),
{name}_s AS (
  SELECT plot_id, cover,
         (coalesce(n1, 0) + coalesce(n2, 0)) / sum(n1) OVER (PARTITION BY plot_id)::DOUBLE AS share
  FROM {name}_j {early}),
{name} AS (SELECT plot_id, {cells} FROM {name}_s WHERE cover IS NOT NULL GROUP BY plot_id)"""


def totals_sql(source: str) -> str:
    leafy = ", ".join(f"'{c}'" for c in FOLIAR_CODES)
    return f"""
canopy_t AS (
  SELECT plot_id, count(lf1) / count(*)::DOUBLE AS can_total_prop,
         avg(CASE WHEN lf1 IN ({leafy}) OR lf2 IN ({leafy}) THEN 1 ELSE 0 END) AS can_foliar_prop
  FROM {source} GROUP BY plot_id),
over_t AS (
  SELECT plot_id, avg(CASE WHEN overstory1 <> '{OVERSTORY_ABSENT}' THEN 1 ELSE 0 END) AS over_total_prop
  FROM {source} GROUP BY plot_id)"""


@query(f"""WITH {SURVEYED_SQL}, {single_layer_sql("surveyed", "ground_cover", KINDS, KIND_TOTALS)}
SELECT * FROM ground""")
def ground_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_layer_cover(survey(spark, sf_dir), "plot_id", "ground_cover", KINDS, KIND_TOTALS)


def _surveyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).na.drop(subset=["ground_cover"])


@query(f"""WITH {SURVEYED_SQL}, {two_layer_sql("surveyed", "canopy", "lf1", "lf2", CANOPY_CODES, False)}
SELECT * FROM canopy""")
def canopy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_layer_cover(_surveyed(spark, sf_dir), "plot_id", "lf1", "lf2", CANOPY_CODES, "surveyed")


@query(f"WITH {SURVEYED_SQL}, {totals_sql('surveyed')} SELECT * FROM canopy_t")
def canopy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canopy_totals_of(_surveyed(spark, sf_dir), "plot_id", "lf1", "lf2", FOLIAR_CODES)


@query(f"""WITH {SURVEYED_SQL},
{two_layer_sql("surveyed", "overstory", "overstory1", "overstory2", OVERSTORY_CODES, True)}
SELECT * FROM overstory""")
def overstory_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_layer_cover(
        _surveyed(spark, sf_dir), "plot_id", "overstory1", "overstory2", OVERSTORY_CODES, "observed"
    )


@query(f"WITH {SURVEYED_SQL}, {totals_sql('surveyed')} SELECT * FROM over_t")
def overstory_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overstory_total_of(_surveyed(spark, sf_dir), "plot_id", "overstory1", OVERSTORY_ABSENT)


# --- plot means and the whole summary ------------------------------------------

MEASURES = ["s_mm_hr0_5", "kfs_mm_hr", "bulk_density_gcm3", "sand_percent", "silt_percent", "clay_percent",
            "total_organic_carbon_percent", "total_nitrogen_percent"]


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged site table with one row per event, made without joins."""
    plot = (F.col("user_id") % 12 + 1).cast("double").alias("plot_id")
    v = F.col("litter_depth_cm")
    # One plot has zero conductivity, hence no geometric mean; one has no carbon.
    return survey_points(spark, sf_dir, plot).withColumns(
        {
            "burn_severity": band("plot_id", SEVERITY_BOUNDS, SEVERITY_ELSE),
            "s_mm_hr0_5": v + 1,
            "kfs_mm_hr": F.when(F.col("plot_id") == 3, 0.0).otherwise(v * 2),
            "bulk_density_gcm3": F.when(v < 40, v / 50),
            "sand_percent": v / 2,
            "silt_percent": v / 3,
            "clay_percent": v / 5,
            "total_organic_carbon_percent": F.when(F.col("plot_id") != 5, v / 100),
            "total_nitrogen_percent": v / 1000,
        }
    )


FULL_SQL = f"""{POINTS_SQL},
full_t AS (
  SELECT *, split_part(location_id, '_', 1)::DOUBLE AS plot_id,
         value + 1 AS s_mm_hr0_5,
         CASE WHEN split_part(location_id, '_', 1) = '3' THEN 0 ELSE value * 2 END AS kfs_mm_hr,
         CASE WHEN value < 40 THEN value / 50 END AS bulk_density_gcm3,
         value / 2 AS sand_percent, value / 3 AS silt_percent, value / 5 AS clay_percent,
         CASE WHEN split_part(location_id, '_', 1) <> '5' THEN value / 100 END AS total_organic_carbon_percent,
         value / 1000 AS total_nitrogen_percent
  FROM points)"""


def _median_sql(depth: int) -> str:
    cells = ", ".join(f"wd_{depth}cm_{r}_sec" for r in (1, 2, 3))
    return f"list_median([{cells}])"


def means_sql(source: str, published: bool = False) -> str:
    """CTE ``means_t``; ``published`` uses first replicates and 0 cm for 3 cm."""
    cells = []
    for depth in range(4):
        used = 0 if published and depth == 3 else depth
        cell = f"wd_{used}cm_1_sec" if published else _median_sql(used)
        cells.append(f"avg({cell}) AS wd_{depth}cm_mean_sec")
    cells += [f"avg(wd_{d}cm_hydrophobic::INT) AS wd_{d}cm_prop" for d in (4, 5)]
    cells += ["avg(litter_depth_cm) AS litter_depth_mean_cm", "avg(theta_i_percent) AS theta_i_mean_percent"]
    for name, out in (("s_mm_hr0_5", "s_geomean_mm_hr0_5"), ("kfs_mm_hr", "kfs_geomean_mm_hr")):
        cells.append(f"CASE WHEN min({name}) > 0 THEN exp(avg(ln(CASE WHEN {name} > 0 THEN {name} END))) END AS {out}")
    cells.append("avg(bulk_density_gcm3) AS bulk_density_mean_gcm3")
    cells += [f"avg({m}) AS {m.replace('_percent', '_mean_percent')}" for m in MEASURES[3:]]
    severity = SEVERITY_CASE.format("plot_id")
    return f"""
means_t AS (SELECT plot_id, {severity} AS burn_severity,
  {", ".join(cells)}
  FROM {source} GROUP BY plot_id)"""


def summary_sql(source: str, published: bool = False) -> str:
    return f"""{means_sql(source, published)},
surveyed AS (SELECT * FROM {source} WHERE ground_cover IS NOT NULL),
{single_layer_sql("surveyed", "ground_cover", GROUND_CODES, GROUND_TOTALS)},
{two_layer_sql("surveyed", "canopy", "lf1", "lf2", CANOPY_CODES, False)},
{two_layer_sql("surveyed", "overstory", "overstory1", "overstory2", OVERSTORY_CODES, True)},
{totals_sql("surveyed")},
summary AS (SELECT * FROM means_t FULL JOIN ground USING (plot_id)
  FULL JOIN canopy USING (plot_id) FULL JOIN canopy_t USING (plot_id)
  FULL JOIN overstory USING (plot_id) FULL JOIN over_t USING (plot_id))"""


MEAN_NAMES = [
    *[f"wd_{d}cm_mean_sec" for d in range(4)], "wd_4cm_prop", "wd_5cm_prop", "litter_depth_mean_cm",
    "theta_i_mean_percent", "s_geomean_mm_hr0_5", "kfs_geomean_mm_hr", "bulk_density_mean_gcm3",
    *[m.replace("_percent", "_mean_percent") for m in MEASURES[3:]],
]
SHARE_NAMES = [
    *GROUND_CODES.values(), *GROUND_TOTALS, *CANOPY_CODES.values(), "can_total_prop", "can_foliar_prop",
    *OVERSTORY_CODES.values(), "over_total_prop",
]


def rounded_summary_sql(names: list[str], source: str) -> str:
    cells = ", ".join(f"{rounded_sql(c)} AS {c}" for c in names)
    return f"SELECT plot_id, burn_severity, {cells} FROM {source}"


@query(f"WITH {FULL_SQL}, {means_sql('full_t')} {rounded_summary_sql(MEAN_NAMES, 'means_t')}")
def plot_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(plot_means_of(full(spark, sf_dir)))


@query(f"WITH {FULL_SQL}, {summary_sql('full_t')} {rounded_summary_sql(MEAN_NAMES + SHARE_NAMES, 'summary')}")
def plot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(plot_summary_of(full(spark, sf_dir)))


@query(f"WITH {FULL_SQL}, {summary_sql('full_t', True)} {rounded_summary_sql(MEAN_NAMES + SHARE_NAMES, 'summary')}")
def plot_summary_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the two slips of the published table."""
    return round_all(plot_summary_of(full(spark, sf_dir), replicate_mode="first", wd3_from_wd0=True))
