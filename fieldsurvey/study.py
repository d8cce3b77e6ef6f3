"""Fixed values of the field study: codes, labels, fit grades and column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsurvey.functions.values import col
from fieldsurvey.sources.delimited import snake

# Upper plot bounds of the burn severity bands.
SEVERITY_BOUNDS = [(4, "high"), (7, "moderate"), (10, "low")]
SEVERITY_ELSE = "unburned"

# Ground cover codes and the columns of their shares.
GROUND_CODES = {
    "B": "grd_bare_soil_prop",
    "F": "grd_forb_prop",
    "L": "grd_litter_prop",
    "G": "grd_graminoid_prop",
    "R": "grd_rock_prop",
    "SD": "grd_standing_dead_prop",
    "WD": "grd_woody_dead_prop",
    "D": "grd_feces_prop",
    "M": "grd_cryptogram_prop",
    "T": "grd_tree_prop",
}
GROUND_TOTALS = {"grd_basal_prop": ["grd_forb_prop", "grd_graminoid_prop", "grd_tree_prop"]}

# Understory canopy codes.
CANOPY_CODES = {
    "F": "can_forb_prop",
    "G": "can_graminoid_prop",
    "L": "can_litter_prop",
    "SD": "can_standing_dead_prop",
    "WD": "can_woody_dead_prop",
    "T": "can_tree_prop",
}
FOLIAR_CODES = ["G", "F", "T"]

# Overstory codes and the code for a dead or open overstory.
OVERSTORY_CODES = {
    "PSME": "over_psme_prop",
    "PIPO": "over_pipo_prop",
    "QUGA": "over_quga_prop",
}
OVERSTORY_ABSENT = "no live"

# Parts of a location key.
KEY_PARTS = ["plot_id", "x_m", "y_m"]

# Plots below this number count as well fitted throughout.
GRADED_FROM_PLOT = 10

# Quality of the three fits per location, in the order
# cumulative infiltration, cumulative linearization, differentiated linearization.
FIT_GRADES = """
10_0_10 good good good
10_2_8 poor poor moderate
10_3_3 moderate moderate good
10_8_8 moderate good good
10_8_2 good good good
10_10_0 good good good
10_0_1 moderate moderate good
10_0_3 good good good
10_0_5 poor poor poor
10_0_0 good good good
10_1_0 good good good
10_1_1 moderate good good
10_3_0 good good good
10_5_0 good poor moderate
10_10_10 good poor poor
10_5_5 moderate moderate moderate
11_8_8 good good good
11_10_10 poor poor poor
11_5_5 good good good
11_3_3 good good good
11_2_8 moderate moderate good
11_0_10 moderate moderate moderate
11_5_0 good good good
11_10_0 good good good
11_8_2 moderate poor moderate
11_0_0 moderate good good
11_1_0 good good good
11_3_0 good good moderate
11_0_5 poor poor poor
11_0_3 good good good
11_0_1 good poor moderate
11_1_1 moderate moderate moderate
12_2_8 moderate moderate moderate
12_8_8 good poor poor
12_8_2 good good good
12_0_3 good good good
12_0_5 good good good
12_0_10 good good good
12_0_0 good good good
12_1_0 good good good
12_3_0 moderate moderate moderate
12_0_1 good good good
12_1_1 good good good
12_5_0 poor poor poor
12_5_5 good good moderate
12_10_0 good poor moderate
12_10_10 good poor moderate
12_3_3 good good good
"""

# Column names of the exported fit table.
FIT_EXPORT = """
location_ID plot_ID x.m y.m burn_severity S.mm_hr0.5 kfs.mm_hr hf.m
c1.CI c2.CI c1.CL c2.CL r2.CL c1.DL c2.DL r2.DL a1 a2 c1 c2 S.cm_sec0.5 kfs.cm_sec
soil_texture_mdi n theta_i.cm3_cm3 theta_s.cm3_cm3 mdiradius.cm alpha.percm tension.cm
CI.fit CL.fit DL.fit
""".split()

# Column names of the exported plot summary.
SUMMARY_EXPORT = """
plot_ID burn_severity
WD_0cm_mean.sec WD_1cm_mean.sec WD_2cm_mean.sec WD_3cm_mean.sec WD_4cm.prop WD_5cm.prop
litter_depth_mean.cm theta_i_mean.percent S_geomean.mm_hr0.5 kfs_geomean.mm_hr
bulk_density_mean.gcm3 sand_mean.percent silt_mean.percent clay_mean.percent
total_organic_carbon_mean.percent total_nitrogen_mean.percent
grd_bare_soil.prop grd_cryptogram.prop grd_feces.prop grd_forb.prop grd_graminoid.prop
grd_litter.prop grd_rock.prop grd_standing_dead.prop grd_tree.prop grd_woody_dead.prop
grd_basal.prop
can_forb.prop can_graminoid.prop can_litter.prop can_standing_dead.prop can_tree.prop
can_woody_dead.prop can_total.prop can_foliar.prop
over_PIPO.prop over_PSME.prop over_QUGA.prop over_total.prop
""".split()

# Column names of the exported merged table; survey columns as in their file.
FULL_EXPORT = """
location_ID plot_ID x.m y.m burn_severity
WD_0cm_1.sec WD_0cm_2.sec WD_0cm_3.sec WD_1cm_1.sec WD_1cm_2.sec WD_1cm_3.sec
WD_2cm_1.sec WD_2cm_2.sec WD_2cm_3.sec WD_3cm_1.sec WD_3cm_2.sec WD_3cm_3.sec
WD_4cm.hydrophobic WD_5cm.hydrophobic litter_depth.cm theta_i.percent
ground_cover LF1 LF2 LF3 overstory1 overstory2
S.mm_hr0.5 kfs.mm_hr hf.m a1 a2 c1 c2 bulk_density.gcm3
sand.percent silt.percent clay.percent total_organic_carbon.percent total_nitrogen.percent
""".split()

# Column letters of the source files.
READINGS_SPEC = "Dfffnnnnn"
SURVEY_SPEC = "c----nnnnnnnnnnnnllnnccccccc"
DENSITY_SPEC = "c----n----------"
SOIL_SPEC = "c----cnnnnn--c"

# Survey codes that are blank rather than missing after merging.
BLANK_CODES = ["lf1", "lf2", "lf3", "overstory1", "overstory2"]

# Fit columns that enter the merged table.
MERGED_FITS = ["location_id", "s_mm_hr0_5", "kfs_mm_hr", "hf_m", "a1", "a2", "c1", "c2"]


def export_names(exported: list[str]) -> dict[str, str]:
    """Our column name to the exported one."""
    return {snake(name): name for name in exported}


def grade_table(spark: SparkSession) -> DataFrame:
    """Fit grades by location: 48 rows."""
    rows = ", ".join(str(tuple(line.split())) for line in FIT_GRADES.strip().splitlines())
    # An inline table, so that its size is known and the engine broadcasts it.
    return spark.sql(f"SELECT * FROM VALUES {rows} AS grades(location_id, ci_fit, cl_fit, dl_fit)")


def grade_default(plot: Column | str = "plot_id") -> Column:
    """Grade of the plots that are not listed one by one."""
    return F.when(col(plot) < GRADED_FROM_PLOT, "good")
