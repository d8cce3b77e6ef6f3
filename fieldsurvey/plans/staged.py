"""The three runs in sequence, each result kept as a table the next one reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from fieldsurvey.functions.hydrology import HydraulicParams
from fieldsurvey.plans.infiltration import infiltration_fit
from fieldsurvey.plans.manifest import Stages, files_of, stamp
from fieldsurvey.plans.site import plot_summary, site_merge
from fieldsurvey.skew import HEAVY_ROWS
from fieldsurvey.sources.delimited import read_table, write_table
from fieldsurvey.study import (
    DENSITY_SPEC,
    FIT_EXPORT,
    FULL_EXPORT,
    READINGS_SPEC,
    SOIL_SPEC,
    SUMMARY_EXPORT,
    SURVEY_SPEC,
    export_names,
    grade_table,
)

EXPORTS = (("fits", ["location_id"], FIT_EXPORT), ("full", [], FULL_EXPORT), ("plot_summary", ["plot_id"], SUMMARY_EXPORT))
SOURCE_SPECS = {
    "readings": READINGS_SPEC,
    "survey": SURVEY_SPEC,
    "density": DENSITY_SPEC,
    "soil": SOIL_SPEC,
}


#: To be raised when a stage gives other rows for the same inputs.
VERSION = 1


def stage(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as parquet and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_stages(
    sources: Mapping[str, DataFrame],
    out_dir: str,
    params: HydraulicParams = HydraulicParams(),
    order: Sequence[str] = (),
    max_rows: int | None = HEAVY_ROWS,
    stamps: Mapping[str, str] | None = None,
    stages: Stages | None = None,
    **summary_options,
) -> dict[str, DataFrame]:
    """Fit, merge and summarise frames ``readings survey density soil``.

    ``order`` sorts the readings of a location. With ``stamps``, texts that change with the rows of
    each source, a run into the same folder reads the stages that an earlier one finished with
    the same sources and parameters; without, the folder must be new.
    """
    spark = sources["readings"].sparkSession
    marks = stage_marks(stamps, params, order, summary_options) if stamps else {}
    stages = stages or Stages(spark, out_dir)

    def kept(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return stages.table(name, marks[name], make) if stamps else stage(make(), f"{out_dir}/{name}")

    def merged() -> DataFrame:
        return site_merge(sources["survey"], fits, sources["density"], sources["soil"], max_rows=max_rows)

    fits = kept("fits", lambda: infiltration_fit(sources["readings"], params, grade_table(spark), order=order, max_rows=max_rows))
    full = kept("full", merged)
    summary = kept("plot_summary", lambda: plot_summary(full, **summary_options))
    return {"fits": fits, "full": full, "plot_summary": summary}


def stage_marks(stamps: Mapping[str, str], params: HydraulicParams, order: Sequence[str], summary_options: Mapping) -> dict[str, str]:
    """What each stage is made of; a stage includes the mark of the one that it reads."""
    fits = stamp(VERSION, stamps["readings"], repr(params), list(order))
    full = stamp(VERSION, fits, *(stamps[s] for s in ("survey", "density", "soil")))
    return {"fits": fits, "full": full, "plot_summary": stamp(VERSION, full, dict(summary_options))}


def run_pipeline(
    spark: SparkSession,
    sources: Mapping[str, str | Sequence[str]],
    params: HydraulicParams,
    out_dir: str,
    stages: Stages | None = None,
    **summary_options,
) -> dict[str, DataFrame]:
    """Delimited files named by ``sources`` to stage tables and exported files.

    A source is a file, a folder or several. Each of its files has the same columns, in any order; the
    letters of its specification belong to the first file by name. A run into the same folder goes on after the
    last stage or export that an earlier run finished with the same files and parameters; files are told by path,
    length and time.
    """
    stages = stages or Stages(spark, out_dir)
    stamps = {name: stamp(spec, files_of(spark, sources[name])) for name, spec in SOURCE_SPECS.items()}
    frames = {name: read_table(spark, sources[name], compact=spec, by_name=True) for name, spec in SOURCE_SPECS.items()}
    tables = run_stages(frames, out_dir, params, stamps=stamps, stages=stages, **summary_options)
    marks = stage_marks(stamps, params, (), summary_options)
    for name, order_by, columns in EXPORTS:
        def write(path: str) -> None:
            write_table(tables[name], path, order_by, names=export_names(columns), mode="overwrite")

        stages.export(f"{name}_csv", stamp(marks[name], columns), write)
    return tables
