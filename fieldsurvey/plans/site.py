"""Merging the sources of a site and summarising them per plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsurvey.functions.aggregates import geomean, mean_, proportion
from fieldsurvey.functions.values import row_median
from fieldsurvey.operators.cover import (
    canopy_total_shares,
    overstory_total_shares,
    single_layer_shares,
    two_layer_shares,
)
from fieldsurvey.operators.frames import fill_text, null_tokens, relocate_first
from fieldsurvey.operators.merge import merge_all
from fieldsurvey.plans.infiltration import with_site
from fieldsurvey.skew import BROADCAST_BYTES, HEAVY_ROWS
from fieldsurvey.study import (
    BLANK_CODES,
    CANOPY_CODES,
    FOLIAR_CODES,
    GROUND_CODES,
    GROUND_TOTALS,
    KEY_PARTS,
    MERGED_FITS,
    OVERSTORY_ABSENT,
    OVERSTORY_CODES,
)

DEPTHS = [0, 1, 2, 3]
REPLICATES = [1, 2, 3]
CODES = ["ground_cover", "lf1", "lf2", "overstory1", "overstory2"]


def site_merge(
    survey: DataFrame,
    fits: DataFrame,
    density: DataFrame,
    soil: DataFrame,
    on: str = "location_id",
    max_rows: int | None = HEAVY_ROWS,
    broadcast_bytes: int | None = BROADCAST_BYTES,
) -> DataFrame:
    """All sources on the location key, with its parts and burn severity.

    Measured sources small enough for every task leave the survey where it is.
    """
    survey = fill_text(survey, [c for c in BLANK_CODES if c in survey.columns])
    fits = fits.select(*[c for c in MERGED_FITS if c in fits.columns])
    soil = soil.withColumnsRenamed({"notes": "notes_soil"})
    # The result does not depend on the order of joining. Every further join
    # shuffles what is merged so far, so the large survey table comes last.
    # Fits have one row per location and may be expensive, so they are not searched.
    merged = merge_all(
        [fits, density, soil, survey], on, null_safe=True, max_rows=max_rows, searched=[1, 2, 3],
        broadcast_bytes=broadcast_bytes,
    )
    columns = [c for df in (survey, fits, density, soil) for c in df.columns if c != on]
    # The grid coordinates stay text in this table.
    return relocate_first(with_site(merged, on, ["plot_id"]), [on, *KEY_PARTS, "burn_severity", *columns])


def plot_mean_columns(replicate_mode: str = "median", wd3_from_wd0: bool = False) -> list[Column]:
    """Means per plot; the flags reproduce two slips of the published table.

    ``replicate_mode="first"`` takes the first drop time for the median, and
    ``wd3_from_wd0`` averages the 0 cm times in place of the 3 cm ones.
    """
    out = []
    for depth in DEPTHS:
        source = 0 if depth == 3 and wd3_from_wd0 else depth
        times = [f"wd_{source}cm_{r}_sec" for r in REPLICATES]
        out.append(mean_(row_median(*times, mode=replicate_mode)).alias(f"wd_{depth}cm_mean_sec"))
    out += [proportion(f"wd_{depth}cm_hydrophobic").alias(f"wd_{depth}cm_prop") for depth in (4, 5)]
    out += [mean_("litter_depth_cm").alias("litter_depth_mean_cm"), mean_("theta_i_percent").alias("theta_i_mean_percent")]
    out += [geomean("s_mm_hr0_5").alias("s_geomean_mm_hr0_5"), geomean("kfs_mm_hr").alias("kfs_geomean_mm_hr")]
    out.append(mean_("bulk_density_gcm3").alias("bulk_density_mean_gcm3"))
    for part in ("sand", "silt", "clay", "total_organic_carbon", "total_nitrogen"):
        out.append(mean_(f"{part}_percent").alias(f"{part}_mean_percent"))
    return out


def _per_plot(df: DataFrame, by: str, columns: list[Column]) -> DataFrame:
    """One row per plot with its burn severity, which must be one per plot.

    Severity is a grouping key: a text aggregate would have all rows sorted.
    """
    grouped = df.groupBy(by, "burn_severity").agg(*columns)
    alone = F.count("*").over(Window.partitionBy(by)) == 1
    checked = grouped.withColumn("_alone", alone)
    return checked.filter(F.assert_true("_alone", "plot has several burn severities").isNull()).drop("_alone")


def plot_means(
    df: DataFrame, by: str = "plot_id", replicate_mode: str = "median", wd3_from_wd0: bool = False
) -> DataFrame:
    return _per_plot(df, by, plot_mean_columns(replicate_mode, wd3_from_wd0))


def cover_columns(where: Column) -> list[Column]:
    """Ground, canopy and overstory shares, in the order of the summary."""
    return [
        *single_layer_shares("ground_cover", GROUND_CODES, GROUND_TOTALS, where),
        *two_layer_shares("lf1", "lf2", CANOPY_CODES, "surveyed", where),
        *canopy_total_shares("lf1", "lf2", FOLIAR_CODES, where),
        *two_layer_shares("overstory1", "overstory2", OVERSTORY_CODES, "observed", where),
        *overstory_total_shares("overstory1", OVERSTORY_ABSENT, where),
    ]


def plot_summary(
    df: DataFrame, by: str = "plot_id", replicate_mode: str = "median", wd3_from_wd0: bool = False
) -> DataFrame:
    """The whole summary from one pass over the merged table.

    Cover shares use surveyed points only, those with a ground cover; means use
    all rows. Blank codes are missing.
    """
    columns = plot_mean_columns(replicate_mode, wd3_from_wd0) + cover_columns(F.col("ground_cover").isNotNull())
    return _per_plot(null_tokens(df, CODES, ("",)), by, columns)
