"""Cover shares: missing codes, empty groups, and the step-by-step form."""

import pytest
from pyspark.sql import functions as F

from fieldsurvey.checks.views import survey
from fieldsurvey.functions.values import recode
from fieldsurvey.operators.cover import (
    canopy_totals,
    overstory_total,
    single_layer_cover,
    two_layer_cover,
)
from fieldsurvey.operators.groups import category_counts, group_representative, quality_sensitivity
from fieldsurvey.operators.frames import fill_zero
from fieldsurvey.operators.merge import full_merge
from fieldsurvey.operators.ordered import share_of_base
from fieldsurvey.operators.reshape import to_long, to_wide
from fieldsurvey.study import CANOPY_CODES, GROUND_CODES, GROUND_TOTALS, OVERSTORY_CODES


def rows(df, key="plot"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def points(spark):
    data = [
        (1, "B", "F", None), (1, "F", None, "F"), (1, "G", None, None), (1, "zz", "T", "F"),
        (2, "B", None, None), (2, "B", None, None),
        (3, "L", None, "G"),
    ]
    return spark.createDataFrame(data, "plot int, ground string, l1 string, l2 string")


def test_ground_shares(points):
    found = rows(single_layer_cover(points, "plot", "ground", GROUND_CODES, GROUND_TOTALS))
    assert found[1].grd_bare_soil_prop == 0.25 and found[1].grd_rock_prop == 0
    assert found[1].grd_basal_prop == 0.5
    assert found[3].grd_litter_prop == 1
    shares = [c for c in found[2].asDict() if c.startswith("grd_") and c != "grd_basal_prop"]
    assert len(shares) == 10 and sum(found[2][c] for c in shares) == 1


def test_canopy_base_counts_missing(points):
    found = rows(two_layer_cover(points, "plot", "l1", "l2", CANOPY_CODES, "surveyed"))
    assert set(found) == {1, 3}
    assert found[1].can_forb_prop == 0.75 and found[1].can_tree_prop == 0.25
    assert found[3].can_graminoid_prop == 1.0


def test_overstory_base_leaves_missing_out(spark):
    data = [(1, "PSME", "QUGA"), (1, "no live", None), (1, None, "PSME"), (2, None, "QUGA"), (3, None, None)]
    df = spark.createDataFrame(data, "plot int, o1 string, o2 string")
    found = rows(two_layer_cover(df, "plot", "o1", "o2", OVERSTORY_CODES, "observed"))
    assert set(found) == {1, 2}
    assert (found[1].over_psme_prop, found[1].over_quga_prop, found[1].over_pipo_prop) == (1.0, 0.5, 0.0)
    assert found[2].over_quga_prop is None
    totals = rows(overstory_total(df, "plot", "o1", "no live"))
    assert totals[1].over_total_prop == pytest.approx(1 / 3) and totals[3].over_total_prop == 0
    with pytest.raises(ValueError):
        two_layer_cover(df, "plot", "o1", "o2", OVERSTORY_CODES, "all")


def test_canopy_totals(points):
    found = rows(canopy_totals(points, "plot", "l1", "l2", ["G", "F", "T"]))
    assert (found[1].can_total_prop, found[1].can_foliar_prop) == (0.5, 0.75)
    assert (found[2].can_total_prop, found[2].can_foliar_prop) == (0, 0)


@pytest.mark.parametrize("base", ["surveyed", "observed"])
def test_fused_equals_steps(spark, sf_dir, base):
    df = survey(spark, sf_dir).na.drop(subset=["ground_cover"])
    codes = CANOPY_CODES
    one = category_counts(df, "plot_id", "lf1", "n1").withColumnsRenamed({"lf1": "cover"})
    two = category_counts(df, "plot_id", "lf2", "n2").withColumnsRenamed({"lf2": "cover"})
    both = full_merge(one, two, ["plot_id", "cover"], null_safe=True)
    if base == "observed":
        both = both.na.drop(subset=["cover"])
    both = both.withColumn("total", F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0)))
    both = both.withColumn("share", share_of_base("total", "n1", ["plot_id"])).na.drop(subset=["cover"])
    named = both.withColumn("cover", recode("cover", codes))
    steps = fill_zero(to_wide(named, "plot_id", "cover", "share", list(codes.values()), fill=None), list(codes.values()))
    fused = two_layer_cover(df, "plot_id", "lf1", "lf2", codes, base)
    assert fused.columns == steps.columns
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, steps.collect()))


def test_wide_refuses_repeats(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "b", 3.0)], "k int, c string, x double")
    with pytest.raises(Exception, match="more than one row"):
        to_wide(df, "k", "c", "x", ["a", "b"]).collect()
    wide = rows(to_wide(df.filter("x > 1"), "k", "c", "x", ["b", "a", "z"]), "k")
    assert list(wide[1].asDict()) == ["k", "a", "b", "z"] and tuple(wide[1]) == (1, 2.0, 0.0, 0.0)
    long = to_long(to_wide(df.filter("x > 1"), "k", "c", "x", ["a", "b"]), ["k"], ["a", "b"], "c", "x")
    assert long.count() == 4


def test_representative(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (3, None)], "k int, s string")
    assert sorted(map(tuple, group_representative(df, "k", "s").collect())) == [(1, "a"), (2, "b"), (3, None)]
    with pytest.raises(Exception, match="several values"):
        group_representative(df.union(spark.createDataFrame([(2, "c")], df.schema)), "k", "s").collect()


def test_quality_rules(spark):
    data = [("x", "good", 1.0), ("x", "poor", 3.0), ("x", "moderate", 5.0), ("x", None, 7.0), ("y", "poor", 2.0)]
    df = spark.createDataFrame(data, "g string, q string, m double")
    found = {(r.g, r.variant): r.mean_m for r in quality_sensitivity(df, "g", ["m"], "q").collect()}
    assert found == {
        ("x", "drop_poor"): 3.0, ("x", "keep_all"): 4.0, ("x", "only_good"): 1.0, ("y", "keep_all"): 2.0,
    }
