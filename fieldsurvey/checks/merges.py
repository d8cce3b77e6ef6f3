"""Full outer merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsurvey.checks.registry import query, round_all, rounded_sql
from fieldsurvey.checks.views import SEVERITY_CASE, SURVEY_SQL, location_key, location_key_sql, survey, table
from fieldsurvey.operators.groups import category_counts
from fieldsurvey.operators.merge import full_merge as merge_two, merge_all
from fieldsurvey.plans.site import site_merge as site_merge_plan


@query(f"""WITH sums AS (SELECT l_orderkey + 7000 AS k, sum(l_quantity) AS quantity, count(*) AS lines
  FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(o_orderkey, k) AS order_id, o_totalprice, {rounded_sql("quantity", 2)} AS quantity, lines
FROM orders FULL JOIN sums ON o_orderkey = k""")
def full_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted keys leave rows without partner on both sides."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_totalprice")
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") + 7000).alias("order_id"))
        .agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    )
    # One row per key on both sides, so no key can be heavy.
    return round_all(merge_two(orders, sums, "order_id", max_rows=None), 2)


@query(f"""WITH {SURVEY_SQL},
one AS (SELECT plot_id, lf1 AS cover, count(*) AS n1 FROM survey GROUP BY ALL),
two AS (SELECT plot_id, lf2 AS cover, count(*) AS n2 FROM survey GROUP BY ALL)
SELECT coalesce(a.plot_id, b.plot_id) AS plot_id, coalesce(a.cover, b.cover) AS cover, n1, n2
FROM one a FULL JOIN two b ON a.plot_id IS NOT DISTINCT FROM b.plot_id AND a.cover IS NOT DISTINCT FROM b.cover""")
def full_merge_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    one = category_counts(rows, "plot_id", "lf1", "n1").withColumnsRenamed({"lf1": "cover"})
    two = category_counts(rows, "plot_id", "lf2", "n2").withColumnsRenamed({"lf2": "cover"})
    # Counted per key, so no key can be heavy.
    return merge_two(one, two, ["plot_id", "cover"], null_safe=True, max_rows=None)


_TYPES = ["click", "error", "purchase", "view"]


def _type_sql(kind: str) -> str:
    # Keys are shifted by source, so that each source lacks some.
    return f"""{kind}_t AS (SELECT user_id + {7 * _TYPES.index(kind)} AS user_id, count(*) AS n_{kind}, max(value) AS max_{kind}
  FROM events WHERE event_type = '{kind}' GROUP BY ALL)"""


@query(f"""WITH {", ".join(_type_sql(t) for t in _TYPES)}
SELECT user_id, {", ".join(f"n_{t}, max_{t}" for t in _TYPES)} FROM click_t
FULL JOIN error_t USING (user_id) FULL JOIN purchase_t USING (user_id) FULL JOIN view_t USING (user_id)""")
def merge_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources with one row per key: one union and one aggregation."""
    events = table(spark, sf_dir, "events")
    sources = [
        events.filter(F.col("event_type") == t)
        .groupBy((F.col("user_id") + 7 * _TYPES.index(t)).alias("user_id"))
        .agg(F.count("*").alias(f"n_{t}"), F.max("value").alias(f"max_{t}"))
        for t in _TYPES
    ]
    return merge_all(sources, "user_id", unique=True)


@query("""WITH kinds AS (SELECT l_orderkey + 700 AS l_orderkey, l_linenumber, l_returnflag AS kind, count(*) AS n
  FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_quantity, kind, n
FROM lineitem FULL JOIN kinds USING (l_orderkey, l_linenumber)""")
def merge_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys on both sides multiply."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    shifted = lines.withColumn("l_orderkey", F.col("l_orderkey") + 700)
    # Hashed by the keys of the join before counting, so that the join needs no second exchange.
    kinds = (
        shifted.repartition("l_orderkey", "l_linenumber")
        .groupBy("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"))
        .agg(F.count("*").alias("n"))
    )
    # At most one row per key and kind on the right, so only the lines are searched.
    return merge_two(lines.drop("l_returnflag"), kinds, ["l_orderkey", "l_linenumber"], searched=[0])


def _shifted_sql(by: int) -> str:
    return location_key_sql(f"(user_id + {by})")


@query(f"""WITH survey AS (SELECT {_shifted_sql(0)} AS location_id, max(value) AS litter_depth_cm,
    coalesce(min(nullif(event_id % 5, 0))::VARCHAR, '') AS lf1
  FROM events WHERE event_type = 'click' GROUP BY ALL),
fits AS (SELECT {_shifted_sql(10)} AS location_id, min(value) AS s_mm_hr0_5, max(value) AS kfs_mm_hr
  FROM events WHERE event_type = 'view' GROUP BY ALL),
density AS (SELECT {_shifted_sql(20)} AS location_id, max(value) AS bulk_density_gcm3
  FROM events WHERE event_type = 'purchase' GROUP BY ALL),
soil AS (SELECT {_shifted_sql(30)} AS location_id, max(value) AS sand_percent,
    CASE event_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS notes_soil
  FROM events WHERE event_type = 'error' GROUP BY ALL),
merged AS (SELECT * FROM survey FULL JOIN fits USING (location_id) FULL JOIN density USING (location_id)
  FULL JOIN soil USING (location_id))
SELECT location_id, split_part(location_id, '_', 1)::DOUBLE AS plot_id, split_part(location_id, '_', 2) AS x_m,
  split_part(location_id, '_', 3) AS y_m,
  {SEVERITY_CASE.format("split_part(location_id, '_', 1)::DOUBLE")} AS burn_severity,
  litter_depth_cm, lf1, s_mm_hr0_5, kfs_mm_hr, bulk_density_gcm3, sand_percent, notes_soil FROM merged""")
def site_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources with keys shifted by source, one with up to two rows per location."""
    events = table(spark, sf_dir, "events")

    def of(kind: str, shift: int, *more) -> DataFrame:
        key = location_key(F.col("user_id") + shift).alias("location_id")
        return events.filter(F.col("event_type") == kind).groupBy(key, *more)

    peak = F.max("value")
    first = F.min(F.nullif(F.col("event_id") % 5, F.lit(0))).cast("string")
    parity = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("notes")
    survey_rows = of("click", 0).agg(peak.alias("litter_depth_cm"), first.alias("lf1"))
    fits = of("view", 10).agg(F.min("value").alias("s_mm_hr0_5"), peak.alias("kfs_mm_hr"))
    density = of("purchase", 20).agg(peak.alias("bulk_density_gcm3"))
    soil = of("error", 30, parity).agg(peak.alias("sand_percent")).select("location_id", "sand_percent", "notes")
    # At most two rows per location in each source, so no location can be heavy.
    return site_merge_plan(survey_rows, fits, density, soil, max_rows=None)


_SPINE = {"c": ("customer", "c_custkey", "c_nationkey", "c_acctbal"), "s": ("supplier", "s_suppkey * 3", "s_nationkey", "s_acctbal"),
          "p": ("part", "p_partkey * 2", "p_size % 25", "p_retailprice"), "o": ("orders", "o_custkey", "o_orderkey % 25", "o_totalprice")}


def _spine_sql(tag: str) -> str:
    name, number, nation, value = _SPINE[tag]
    return f"""{tag}_t AS (SELECT CASE WHEN {number} >= 40 THEN {number} END AS key, {nation} AS nation, {value} AS {tag}_value FROM {name})"""


def _spine_join(tag: str) -> str:
    return f"""FULL JOIN {tag}_t ON m.key IS NOT DISTINCT FROM {tag}_t.key AND m.nation IS NOT DISTINCT FROM {tag}_t.nation"""


@query(f"""WITH {", ".join(_spine_sql(t) for t in _SPINE)},
m1 AS (SELECT coalesce(m.key, s_t.key) AS key, coalesce(m.nation, s_t.nation) AS nation, c_value, s_value FROM c_t m {_spine_join("s")}),
m2 AS (SELECT coalesce(m.key, p_t.key) AS key, coalesce(m.nation, p_t.nation) AS nation, c_value, s_value, p_value FROM m1 m {_spine_join("p")}),
m3 AS (SELECT coalesce(m.key, o_t.key) AS key, coalesce(m.nation, o_t.nation) AS nation, c_value, s_value, p_value, o_value FROM m2 m {_spine_join("o")})
SELECT nation, key IS NULL AS no_key, count(*) AS n, count(c_value) AS n_c, count(s_value) AS n_s, count(p_value) AS n_p, count(o_value) AS n_o,
  min(key) AS first_key, max(key) AS last_key, min(c_value) AS c_low, max(p_value) AS p_high, max(o_value) AS o_high
FROM m3 GROUP BY ALL""")
def merge_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources that repeat keys and lack some, along a spine of their keys; summed up per nation.

    Small numbers are missing, so that each nation has a missing key that several sources repeat;
    those are heavy here, found by the search and merged apart.
    """
    frames = []
    for tag, (name, number, nation, value) in _SPINE.items():
        key = F.expr(f"CASE WHEN {number} >= 40 THEN {number} END")
        frames.append(table(spark, sf_dir, name).select(key.alias("key"), F.expr(nation).cast("int").alias("nation"), F.expr(value).alias(f"{tag}_value")))
    merged = merge_all(frames, ["key", "nation"], null_safe=True, max_rows=20)
    return merged.groupBy("nation", F.col("key").isNull().alias("no_key")).agg(
        F.count("*").alias("n"),
        *[F.count(f"{t}_value").alias(f"n_{t}") for t in _SPINE],
        F.min("key").alias("first_key"), F.max("key").alias("last_key"),
        F.min("c_value").alias("c_low"), F.max("p_value").alias("p_high"), F.max("o_value").alias("o_high"),
    )
