"""Site merge, plot summary and the staged run on files."""

import csv
import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fieldsurvey.functions.hydrology import HydraulicParams
from fieldsurvey.plans.site import plot_means, plot_summary, site_merge
from fieldsurvey.plans import staged
from fieldsurvey.plans.manifest import Stages, files_of
from fieldsurvey.plans.staged import run_pipeline
from fieldsurvey.scratch import new_table_path, shared_folder
from fieldsurvey.study import FULL_EXPORT, SUMMARY_EXPORT, export_names

# Measured bulk densities by location, four per plot.
DENSITY = """
1_0_0 0.9932258060000001
1_0_10 0.9878571429999999
1_10_0 1.054333333
1_10_10 1.4126666669999997
2_0_0 1.062580645
2_0_10 1.354193548
2_10_0 1.0785714290000001
2_10_10 1.08875
3_0_0 NA
3_0_10 1.1562500000000002
3_10_0 0.896285714
3_10_10 1.0335294119999996
7_0_0 1.2278947369999995
7_0_10 1.0905
7_10_0 0.7583333329999999
7_10_10 0.974814815
"""

# Texture class, sand, silt, clay, carbon and nitrogen by location.
SOIL = """
2_0_0,Sandy Loam,72,24,4,2.6,0.13
2_0_10,Loamy Sand,76,20,4,2,0.11
2_NA_NA,Loamy Sand,76,22,2,2.5,0.15000000000000002
2_NA_NA,Sandy Loam,74,22,4,3.3,0.18
7_0_0,Sandy Loam,72,22,6,2.7,0.14
7_0_10,Sandy Loam,70,26,4,1.6,0.12000000000000001
7_10_0,NA,NA,NA,NA,3,0.22
7_10_10,Sandy Loam,68,28,4,2.5,0.19
"""

# Published means of density by plot, and of the soil columns.
DENSITY_MEANS = {1: 1.1120207372499997, 2: 1.1460239055, 3: 1.0286883753333333, 7: 1.0128857212499995}
SOIL_MEANS = {
    2: (74.5, 22, 3.5, 2.6, 0.14250000000000002),
    7: (70, 25.333333333333332, 4.666666666666667, 2.45, 0.1675),
}

GRID = [f"{p}_{x}_{y}" for p in (1, 2, 3, 7) for x in (0, 10) for y in (0, 10)]
TIMES = [16.0, 25.0, 36.0, 49.0, 64.0, 100.0, 144.0]


def cell(value):
    return "NA" if value is None else value


def write_csv(path, header, rows):
    with open(path, "w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(header)
        writer.writerows([[cell(v) for v in row] for row in rows])
    return str(path)


def survey_row(i, key):
    drops = [float((i + d * r) % 5) if (i + d) % 4 else None for d in range(4) for r in (1, 2, 3)]
    codes = ["B" if i % 2 else "F", "G" if i % 3 else None, "F" if i % 4 == 0 else None, None,
             "PSME" if i % 2 else "no live", None, "note"]
    return [key, *["skip"] * 4, *drops, "T" if i % 2 else "F", "F", 1.5, 0.3 * i, *codes]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sources")
    drops = [f"WD_{d}cm_{r}.sec" for d in range(4) for r in (1, 2, 3)]
    density = [line.split() for line in DENSITY.strip().splitlines()]
    soil = [line.split(",") for line in SOIL.strip().splitlines()]
    readings = [
        ("2020-07-13", key, "a", "b", 0, t, 0, 0.1 * math.sqrt(t) + 0.01 * t, 0) for key in GRID for t in TIMES
    ]
    return {
        "density": write_csv(
            folder / "density.csv",
            ["location_ID", *[f"p{i}" for i in range(4)], "bulk_density.gcm3", *[f"q{i}" for i in range(10)]],
            [[k, 1, 2, 3, "x", v, *["z"] * 10] for k, v in density],
        ),
        "soil": write_csv(
            folder / "soil.csv",
            ["location_ID", *[f"p{i}" for i in range(4)], "soil_texture_class", "sand.percent", "silt.percent",
             "clay.percent", "total_organic_carbon.percent", "total_nitrogen.percent", "s", "c", "Notes"],
            [[k, "x", 1, 2, 3, *vals, "i", "j", None] for k, *vals in soil],
        ),
        "survey": write_csv(
            folder / "survey.csv",
            ["location_ID", *[f"p{i}" for i in range(4)], *drops, "WD_4cm.hydrophobic", "WD_5cm.hydrophobic",
             "litter_depth.cm", "theta_i.percent", "ground_cover", "LF1", "LF2", "LF3", "overstory1", "overstory2", "remark"],
            [survey_row(i, key) for i, key in enumerate(GRID)],
        ),
        "readings": write_csv(
            folder / "readings.csv",
            ["date", "location_ID", "f1", "f2", "n1", "time.sec", "n2", "I.cm", "n3"], readings,
        ),
    }


@pytest.fixture(scope="module")
def run(spark, files):
    return run_pipeline(spark, files, HydraulicParams(), new_table_path(spark, "run"))


def test_full_table(run):
    full = run["full"]
    assert len(full.columns) == 43
    assert full.columns[:5] == ["location_id", "plot_id", "x_m", "y_m", "burn_severity"]
    found = full.groupBy("location_id").count().collect()
    assert {r["count"] for r in found if r.location_id == "2_NA_NA"} == {2}
    assert len(found) == len(GRID) + 1
    unsurveyed = full.filter("location_id = '2_NA_NA'").first()
    assert unsurveyed.lf1 is None and unsurveyed.x_m is None and unsurveyed.plot_id == 2
    assert full.filter("lf3 = ''").count() == len(GRID)


def test_published_means(run):
    found = {int(r.plot_id): r for r in run["plot_summary"].collect()}
    for plot, mean in DENSITY_MEANS.items():
        assert found[plot].bulk_density_mean_gcm3 == pytest.approx(mean, rel=1e-14)
    for plot, means in SOIL_MEANS.items():
        names = ("sand", "silt", "clay", "total_organic_carbon", "total_nitrogen")
        assert [found[plot][f"{n}_mean_percent"] for n in names] == pytest.approx(list(means), rel=1e-14)


def test_summary_invariants(run):
    summary = run["plot_summary"]
    assert summary.columns == list(export_names(SUMMARY_EXPORT)) and len(summary.columns) == 41
    for r in summary.collect():
        ground = [v for k, v in r.asDict().items() if k.startswith("grd_") and k != "grd_basal_prop"]
        assert len(ground) == 10 and sum(ground) == pytest.approx(1)
        assert r.grd_basal_prop == r.grd_forb_prop + r.grd_graminoid_prop + r.grd_tree_prop
        assert r.s_geomean_mm_hr0_5 == pytest.approx(600 * 0.1 / 1.070446972390221, rel=1e-3)


def test_exports_carry_published_names(spark, run, files):
    folder = run["plot_summary"].inputFiles()[0].rsplit("/plot_summary/", 1)[0]
    exported = spark.read.csv(f"{folder}/plot_summary_csv", header=True)
    assert exported.columns == SUMMARY_EXPORT
    assert [r[0] for r in exported.select("plot_ID").collect()] == ["1", "2", "3", "7"]
    full = spark.read.csv(f"{folder}/full_csv", header=True)
    assert full.count() == run["full"].count()
    assert set(FULL_EXPORT) - set(full.columns) == set() and full.columns[:5] == FULL_EXPORT[:5]


def test_means_flags(run):
    full = run["full"]
    plain = {r.plot_id: r for r in plot_means(full).collect()}
    slips = {r.plot_id: r for r in plot_means(full, replicate_mode="first", wd3_from_wd0=True).collect()}
    assert all(r.wd_3cm_mean_sec == r.wd_0cm_mean_sec for r in slips.values())
    assert any(plain[p].wd_1cm_mean_sec != slips[p].wd_1cm_mean_sec for p in plain)


def test_summary_without_survey(run):
    """Plots without any surveyed point have means but no shares."""
    full = run["full"].withColumn("ground_cover", F.when(F.col("plot_id") != 1, F.col("ground_cover")))
    found = {int(r.plot_id): r for r in plot_summary(full).collect()}
    assert found[1].grd_forb_prop is None and found[1].can_total_prop is None and found[1].over_total_prop is None
    assert found[1].bulk_density_mean_gcm3 is not None and found[2].grd_forb_prop is not None


def test_two_severities_in_one_plot_are_an_error(run):
    mixed = run["full"].withColumn("burn_severity", F.when(F.col("x_m") == "0", "high").otherwise("low"))
    with pytest.raises(Exception, match="several burn severities"):
        plot_means(mixed).collect()


def test_heavy_location_merges_the_same(run, spark):
    fits = run["fits"]
    survey = spark.range(60).select(
        F.when(F.col("id") < 20, "1_0_0").otherwise(F.concat(F.lit("3_0_"), F.col("id") % 15)).alias("location_id"),
        F.col("id").cast("double").alias("litter_depth_cm"),
    )
    density = fits.select("location_id", F.lit(1.0).alias("bulk_density_gcm3"))
    soil = spark.createDataFrame([("1_0_0", 50.0, "n"), ("1_0_0", 60.0, None)], "location_id string, sand_percent double, notes string")
    plain = site_merge(survey, fits, density, soil, max_rows=None)
    cut = site_merge(survey, fits, density, soil, max_rows=10)
    assert plain.columns == cut.columns
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, cut.collect()))
    assert plain.filter("location_id = '1_0_0'").count() == 40


def test_paths_are_fresh(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert new_table_path(spark, "x") != new_table_path(spark, "x")


def test_cluster_without_shared_folder_is_an_error():
    class Context:
        master = "spark://host"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="shared folder"):
        shared_folder(Session)


def test_cluster_takes_the_folder_that_its_session_names():
    """Without a scheme and with local files as the default store, as with a mounted folder."""

    class Context:
        master = "local-cluster[3,2,1024]"
        folder = None
        _jsc = SimpleNamespace(hadoopConfiguration=lambda: {"fs.defaultFS": "file:///"})

        @classmethod
        def getCheckpointDir(cls):
            return cls.folder

        @classmethod
        def setCheckpointDir(cls, folder):
            cls.folder = folder

    class Session:
        sparkContext = Context
        conf = {"spark.checkpoint.dir": "/mnt/shared"}

    assert shared_folder(Session) == "/mnt/shared"
    assert Context.folder == "/mnt/shared"


def summary_rows(tables):
    return sorted(map(repr, tables["plot_summary"].collect()))


def killed(*args, **kwargs):
    raise RuntimeError("killed")


def test_killed_run_goes_on_after_its_last_stage(spark, files, run, monkeypatch):
    """Stopped in its third stage, and again in its exports: finished stages are read, not made again."""
    folder = new_table_path(spark, "restart")
    with monkeypatch.context() as m:
        m.setattr(staged, "plot_summary", killed)
        with pytest.raises(RuntimeError, match="killed"):
            run_pipeline(spark, files, HydraulicParams(), folder)
    made = [f for f in files_of(spark, folder) if "/fits/" in f[0] or "/full/" in f[0]]
    write_table = staged.write_table
    with monkeypatch.context() as m:
        m.setattr(staged, "infiltration_fit", killed)
        m.setattr(staged, "site_merge", killed)
        m.setattr(staged, "write_table", lambda df, path, *a, **k: write_table(df, path, *a, **k) if "fits" in path else killed())
        stages = Stages(spark, folder)
        with pytest.raises(RuntimeError, match="killed"):
            run_pipeline(spark, files, HydraulicParams(), folder, stages=stages)
        assert stages.reused == ["fits", "full"]
    stages = Stages(spark, folder)
    tables = run_pipeline(spark, files, HydraulicParams(), folder, stages=stages)
    assert stages.reused == ["fits", "full", "plot_summary", "fits_csv"]
    assert [f for f in files_of(spark, folder) if f in made] == made
    assert summary_rows(tables) == summary_rows(run)
    assert spark.read.csv(f"{folder}/plot_summary_csv", header=True).columns == SUMMARY_EXPORT


def test_changed_inputs_parameters_and_files_are_made_again(spark, files, run, tmp_path):
    folder = new_table_path(spark, "again")
    own = dict(files, soil=str(tmp_path / "soil.csv"))
    content = open(files["soil"]).read()
    (tmp_path / "soil.csv").write_text(content)
    run_pipeline(spark, own, HydraulicParams(), folder)

    def reused(params=HydraulicParams(), **options):
        stages = Stages(spark, folder)
        tables = run_pipeline(spark, own, params, folder, stages=stages, **options)
        return stages.reused, tables

    every = ["fits", "full", "plot_summary", "fits_csv", "full_csv", "plot_summary_csv"]
    names, tables = reused()
    assert names == every and summary_rows(tables) == summary_rows(run)
    assert reused(replicate_mode="first")[0] == ["fits", "full", "fits_csv", "full_csv"]
    # Another source below the second stage, then a file of the first stage lost.
    (tmp_path / "soil.csv").write_text(content.replace("Loamy Sand,76,20,4", "Loamy Sand,76,10,14"))
    names, tables = reused()
    assert names == ["fits", "fits_csv"] and summary_rows(tables) != summary_rows(run)
    (tmp_path / "soil.csv").write_text(content)
    reused()
    import os

    lost = next(f for f, n, _ in files_of(spark, f"{folder}/fits") if n)
    os.remove(lost.removeprefix("file:"))
    names, tables = reused()
    # Later stages are made of the same inputs, so they stand.
    assert names == [s for s in every if s != "fits"] and summary_rows(tables) == summary_rows(run)
    # Without stamps the folder must be new.
    with pytest.raises(Exception, match="(?i)exist"):
        staged.stage(tables["fits"], f"{folder}/fits")
