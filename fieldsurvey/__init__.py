"""Field-survey analytics as PySpark DataFrame operators.

Sub-packages: ``sources`` (delimited input and output), ``functions`` (Column
builders), ``operators`` (DataFrame to DataFrame), ``plans`` (the composed
fit, merge and summary runs) and ``checks`` (queries over the test tables with
equivalent SQL). The public names are gathered here.
"""

from fieldsurvey.functions.aggregates import (
    coverage,
    fit_line,
    fit_r2,
    fit_two_term,
    geomean,
    mean_,
    proportion,
    representative,
)
from fieldsurvey.functions.hydrology import (
    HydraulicParams,
    coef_a1,
    coef_a2,
    conductivity,
    front_head,
    sorptivity,
)
from fieldsurvey.functions.values import (
    band,
    flag,
    parse_date,
    parse_logical,
    parse_number,
    recode,
    row_mean,
    row_median,
    row_sum,
    to_number,
)
from fieldsurvey.operators.cover import (
    canopy_totals,
    overstory_total,
    single_layer_cover,
    two_layer_cover,
)
from fieldsurvey.operators.groups import category_counts, group_representative, quality_sensitivity
from fieldsurvey.operators.frames import (
    fill_text,
    fill_zero,
    lookup,
    null_negative,
    null_tokens,
    null_where,
    relocate_first,
    split_key,
    with_params,
)
from fieldsurvey.operators.merge import assert_unique, full_merge, merge_all
from fieldsurvey.operators.ordered import (
    finite_diff,
    neighbour_geomean,
    next_value,
    share_of_base,
    share_of_group,
    slice_heavy_groups,
    with_next,
)
from fieldsurvey.operators.reshape import to_long, to_wide
from fieldsurvey.plans.infiltration import (
    coefficients_long,
    fit_methods,
    infiltration_features,
    infiltration_fit,
    mean_estimates,
)
from fieldsurvey.plans.site import plot_means, plot_summary, site_merge
from fieldsurvey.plans.staged import run_pipeline, run_stages
from fieldsurvey.sources.delimited import compact_schema, parse_col, read_codes, read_table, write_table
from fieldsurvey.study import grade_default, grade_table

__all__ = [name for name in dir() if not name.startswith("_")]
