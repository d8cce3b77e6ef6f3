"""Full outer merging: missing keys, repeated keys, heavy keys."""

import pytest
from pyspark.sql import functions as F

from fieldsurvey.operators import merge
from fieldsurvey.operators.merge import assert_unique, full_merge, merge_all


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def cover(spark):
    left = spark.createDataFrame([(1, "G", 3), (1, None, 2)], "p int, c string, n1 int")
    right = spark.createDataFrame([(1, "F", 1), (1, None, 7)], "p int, c string, n2 int")
    return left, right


@pytest.mark.parametrize("options", [{}, {"unique": True}, {"max_rows": None}, {"max_rows": 1}])
def test_missing_keys_match_each_other(cover, options):
    merged = full_merge(*cover, ["p", "c"], null_safe=True, **options)
    assert set(map(tuple, merged.collect())) == {(1, "G", 3, None), (1, "F", None, 1), (1, None, 2, 7)}


@pytest.mark.parametrize("options", [{}, {"unique": True}, {"max_rows": None}, {"max_rows": 1}])
def test_missing_keys_stay_apart(cover, options):
    merged = full_merge(*cover, ["p", "c"], **options)
    assert sorted(map(repr, map(tuple, merged.collect()))) == sorted(
        map(repr, [(1, "G", 3, None), (1, "F", None, 1), (1, None, 2, None), (1, None, None, 7)])
    )


def test_repeated_key_kept(spark):
    soil = spark.createDataFrame([("2_NA_NA", 76), ("2_NA_NA", 74), ("2_0_0", 72)], "k string, sand int")
    density = spark.createDataFrame([("2_0_0", 1.06), ("2_10_0", 1.07)], "k string, density double")
    expected = [("2_0_0", 72, 1.06), ("2_10_0", None, 1.07), ("2_NA_NA", 74, None), ("2_NA_NA", 76, None)]
    for max_rows in (None, 100, 1):
        merged = full_merge(soil, density, "k", max_rows=max_rows)
        assert sorted(map(repr, map(tuple, merged.collect()))) == sorted(map(repr, expected))


def test_unique_refuses_repeated_key(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "k int, a int")
    b = spark.createDataFrame([(1, 5)], "k int, b int")
    with pytest.raises(Exception, match="repeats a key"):
        full_merge(a, b, "k", unique=True).select("k").collect()
    with pytest.raises(ValueError):
        assert_unique(a, ["k"])
    assert assert_unique(b, ["k"]) is b


def test_shared_column_names_refused(spark):
    a = spark.createDataFrame([(1, 1)], "k int, a int")
    with pytest.raises(ValueError):
        full_merge(a, a, "k")


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("max_rows, broadcast", [(5, 0), (40, 0), (40, 50), (300, 0), (5, 100_000)])
def test_heavy_keys_change_nothing(spark, monkeypatch, null_safe, max_rows, broadcast):
    """A third of one source in one key, heavy keys in one, two or all sources, and copies."""
    monkeypatch.setattr(merge, "BROADCAST_KEYS", broadcast)
    n = F.col("id")
    hot = F.when(n % 3 == 0, F.lit(1)).when(n % 11 == 0, F.lit(None)).otherwise(n % 50)
    a = spark.range(600).select(hot.cast("int").alias("k"), (n % 4).alias("a"))
    b = spark.range(30).select((n % 20 + 1).cast("int").alias("k"), n.alias("b"))
    c = spark.range(300).select(F.when(n % 2 == 0, F.lit(77)).when(n < 4, F.lit(None)).otherwise(n % 60).cast("int").alias("k"), n.alias("c"))
    plain = merge_all([a, b, c], "k", null_safe, max_rows=None)
    assert rows(merge_all([a, b, c], "k", null_safe, max_rows=max_rows)) == rows(plain)


def test_salts_spread_a_heavy_key(spark, monkeypatch):
    """Neither side is small: rows of one key land under many salts, whole on both sides."""
    monkeypatch.setattr(merge, "BROADCAST_KEYS", 0)
    a = spark.range(400).select(F.lit(1).alias("k"), F.lit("copy").alias("a"))
    b = spark.range(3).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    heavy = merge._heavy_keys([a, b], ["k"], 100)
    left, right = merge._salt_both(a, b, ["k"], heavy, 1, 100, True)
    assert left.count() == 400 and left.select(merge.SALT).distinct().count() == 12
    assert left.groupBy(merge.SALT).count().agg(F.max("count")).first()[0] < 100
    assert right.groupBy(merge.SALT).count().filter("count = 3").count() == 12
    assert full_merge(a, b, "k", max_rows=100).count() == 1200


def test_unique_form_equals_chain(spark):
    frames = [
        spark.range(i, 60, i + 1).select(F.col("id").alias("k"), (F.col("id") * i).alias(f"v{i}")) for i in range(4)
    ]
    assert rows(merge_all(frames, "k", unique=True)) == rows(merge_all(frames, "k", max_rows=None))


def test_moderate_keys_with_a_huge_product_are_found(spark):
    """The search alone, at the real threshold: 2,000 rows of one key in each of three sources."""
    frames = [
        spark.range(50_000).select(F.when(F.col("id") < 2_000, 0).otherwise(F.col("id")).alias("k"), F.lit(1).alias(f"v{i}"))
        for i in range(3)
    ]
    heavy = merge._heavy_keys(frames, ["k"], merge.HEAVY_ROWS)
    assert [r.k for r in heavy.select("k").collect()] == [0]


def test_no_source_searched(cover):
    assert full_merge(*cover, ["p", "c"], null_safe=True, searched=[]).count() == 3


def test_unique_form_keeps_missing_keys_of_one_source_apart(spark):
    a = spark.createDataFrame([(None, 1), (None, 2), (3, 5)], "k int, a int")
    b = spark.createDataFrame([(None, 7), (3, 8)], "k int, b int")
    assert rows(full_merge(a, b, "k", unique=True)) == rows(full_merge(a, b, "k", max_rows=None))


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_small_others_leave_the_last_frame_in_place(spark, null_safe, limit):
    n = F.col("id")
    a = spark.range(20).select(F.when(n % 5 > 0, n % 13).alias("k"), n.alias("a"))
    b = spark.range(9).select(F.when(n > 1, n * 3).alias("k"), n.alias("b"))
    c = spark.range(300).select(F.when(n % 7 > 0, n % 17).alias("k"), n.alias("c"))
    plain = merge_all([a, b, c], "k", null_safe, max_rows=None)
    assert rows(merge_all([a, b, c], "k", null_safe, max_rows=None, broadcast_bytes=limit)) == rows(plain)


def shapes(spark):
    """Four sources: repeated keys in two parts, missing parts, keys of one source only."""
    n = F.col("id")
    k, part = F.when(n % 7 > 0, n % 13), F.when(n % 5 > 1, F.concat(F.lit("p"), n % 3))
    return [
        spark.range(rows).select((k + shift).alias("k"), part.alias("part"), n.alias(f"v{rows}")) for rows, shift in ((60, 0), (25, 4), (1, 0), (90, 9))
    ]


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("on", [["k", "part"], ["k"]])
@pytest.mark.parametrize("max_rows", [None, 50])
def test_spine_equals_chain(spark, null_safe, on, max_rows):
    frames = [f.drop("part") if on == ["k"] else f for f in shapes(spark)]
    chain = merge_all(frames, on, null_safe, max_rows=None, spine=False)
    merged = merge_all(frames, on, null_safe, max_rows=max_rows)
    assert merged.columns == chain.columns and merged.dtypes == chain.dtypes and rows(merged) == rows(chain)


def test_spine_of_empty_sources(spark):
    frames = [f.limit(0) for f in shapes(spark)]
    assert merge_all(frames, ["k", "part"], max_rows=None).count() == 0
    assert merge_all([*frames[:3], shapes(spark)[3]], ["k", "part"], True, max_rows=None).count() == 90


@pytest.mark.parametrize("null_safe", [True, False])
def test_spine_moves_every_source_once(spark, null_safe, tmp_path):
    """One exchange for the keys and one for each source; nothing merged is moved or sorted again."""
    frames = []
    for i, frame in enumerate(shapes(spark)):
        frame.write.parquet(f"{tmp_path}/{i}")
        frames.append(spark.read.parquet(f"{tmp_path}/{i}"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        text = merge_all(frames, ["k", "part"], null_safe, max_rows=None)._jdf.queryExecution().executedPlan().toString()
        chain = merge_all(frames, ["k", "part"], null_safe, max_rows=None, spine=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert text.count("Exchange hashpartitioning") == 5 and text.count("SortMergeJoin") == 4
    assert text.count("Sort [") == 5
    assert chain.count("Exchange hashpartitioning") == 6


@pytest.mark.parametrize("first", [1, 64, 1 << 20])
def test_search_by_buckets_finds_all_heavy_keys(spark, monkeypatch, first):
    """Few buckets at first: all are heavy, so more are made; what is found is the same."""
    monkeypatch.setattr(merge, "FIRST_BUCKETS", first)
    n = F.col("id")
    frames = [
        spark.range(4_000).select(F.when(n < 40 * i, -1).when(n % 10 == 0, F.lit(None)).otherwise(n % 1_500).cast("int").alias("k"), n.alias(f"v{i}"))
        for i in (1, 2, 3)
    ]
    heavy = merge._heavy_keys(frames, ["k"], 1_000)
    counted = [{r.k: r["count"] for r in f.groupBy("k").count().collect()} for f in frames]
    product = {k: max(counted[0].get(k, 0), 1) * max(counted[1].get(k, 0), 1) * max(counted[2].get(k, 0), 1) for k in set().union(*counted)}
    assert {r.k for r in heavy.collect()} == {k for k, n in product.items() if n > 1_000} == {-1, None}
    assert {(r._n0, r._n1, r._n2) for r in heavy.filter("k = -1").collect()} == {(40, 80, 120)}
    assert merge._heavy_keys(frames, ["k"], 10**12) is None


def test_keys_outside_heavy_buckets_are_not_counted(spark):
    """Of 150,000 rows only those of the heavy key, and of what shares its bucket, go on to the exact count."""
    frames = {
        i: spark.range(50_000).select(F.when(F.col("id") < 2_000, 0).otherwise(F.col("id")).alias("k")) for i in range(3)
    }
    met = merge._in_heavy_buckets(frames, ["k"], merge.HEAVY_ROWS)
    assert all(2_000 <= df.count() < 2_100 for df in met.values())
