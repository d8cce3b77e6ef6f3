"""Group summaries, shares and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsurvey.checks.registry import query, round_all, rounded_sql
from fieldsurvey.checks.views import SEVERITY_CASE, SURVEY_SQL, survey, table
from fieldsurvey.functions.aggregates import coverage, geomean, mean_, proportion
from fieldsurvey.functions.values import band, recode
from fieldsurvey.operators.groups import category_counts as count_categories
from fieldsurvey.operators.groups import group_representative as representative_of
from fieldsurvey.operators.groups import layer_counts as count_layers
from fieldsurvey.operators.frames import fill_zero
from fieldsurvey.operators.ordered import ordered_scan, share_of_base, share_of_group, with_share
from fieldsurvey.operators.reshape import to_long, to_wide
from fieldsurvey.study import SEVERITY_BOUNDS, SEVERITY_ELSE


@query(f"""SELECT l_returnflag, l_linestatus, {rounded_sql("avg(nullif(l_quantity, 25))", 4)} AS mean_quantity,
  {rounded_sql("avg(l_extendedprice)", 4)} AS mean_price, {rounded_sql("avg(l_tax)", 4)} AS mean_tax
FROM lineitem GROUP BY ALL""")
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return round_all(
        rows.groupBy("l_returnflag", "l_linestatus").agg(
            mean_(F.nullif("l_quantity", F.lit(25.0))).alias("mean_quantity"),
            mean_("l_extendedprice").alias("mean_price"),
            mean_("l_tax").alias("mean_tax"),
        ),
        4,
    )


@query("""SELECT user_id, avg(CASE WHEN event_type <> 'error' THEN (value > 10)::INT END) AS share
FROM events GROUP BY user_id""")
def group_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.when(F.col("event_type") != "error", F.col("value") > 10)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(proportion(large).alias("share"))


@query(f"""SELECT c_nationkey, c_mktsegment, CASE WHEN min(c_acctbal) > 0
  THEN {rounded_sql("exp(avg(ln(CASE WHEN c_acctbal > 0 THEN c_acctbal END)))", 4)} END AS balance
FROM customer GROUP BY c_nationkey, c_mktsegment""")
def group_geomean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with a balance at or below zero have no geometric mean."""
    groups = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment")
    return round_all(groups.agg(geomean("c_acctbal").alias("balance")), 4)


@query(f"WITH {SURVEY_SQL} SELECT plot_id, lf1, count(*) AS n FROM survey GROUP BY plot_id, lf1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_categories(survey(spark, sf_dir), "plot_id", "lf1")


@query(f"""WITH {SURVEY_SQL}
SELECT plot_id, count(lf2) / count(*)::DOUBLE AS covered FROM survey GROUP BY plot_id""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).groupBy("plot_id").agg(coverage("lf2").alias("covered"))


@query(f"""WITH {SURVEY_SQL}
SELECT plot_id, {SEVERITY_CASE.format("plot_id")} AS severity FROM survey GROUP BY plot_id""")
def group_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = band("plot_id", SEVERITY_BOUNDS, SEVERITY_ELSE)
    return representative_of(survey(spark, sf_dir).withColumn("severity", severity), "plot_id", "severity")


@query(f"""WITH {SURVEY_SQL},
counts AS (SELECT plot_id, ground_cover, count(*) AS n FROM survey GROUP BY ALL)
SELECT plot_id, ground_cover, n, n / sum(n) OVER (PARTITION BY plot_id)::DOUBLE AS share FROM counts""")
def group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_categories(survey(spark, sf_dir), "plot_id", "ground_cover")
    return counts.withColumn("share", share_of_group("n", ["plot_id"]))


@query(f"""WITH {SURVEY_SQL},
one AS (SELECT plot_id, lf1 AS cover, count(*) AS n1 FROM survey GROUP BY ALL),
two AS (SELECT plot_id, lf2 AS cover, count(*) AS n2 FROM survey GROUP BY ALL)
SELECT coalesce(a.plot_id, b.plot_id) AS plot_id, coalesce(a.cover, b.cover) AS cover,
  (coalesce(n1, 0) + coalesce(n2, 0)) / sum(n1) OVER (PARTITION BY coalesce(a.plot_id, b.plot_id))::DOUBLE AS share
FROM one a FULL JOIN two b ON a.plot_id IS NOT DISTINCT FROM b.plot_id AND a.cover IS NOT DISTINCT FROM b.cover""")
def share_of_first_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = count_layers(survey(spark, sf_dir), "plot_id", {"n1": "lf1", "n2": "lf2"})
    both = both.withColumn("total", F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0)))
    return both.select("plot_id", "cover", share_of_base("total", "n1", ["plot_id"]).alias("share"))


_KINDS = ["click", "purchase", "signup", "unused", "view"]


@query(f"""WITH {SURVEY_SQL}
SELECT plot_id, {", ".join(f"count(*) FILTER (ground_cover = '{k}') / count(*)::DOUBLE AS kind_{k}" for k in _KINDS)}
FROM survey WHERE ground_cover IS NOT NULL GROUP BY plot_id""")
def pivot_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, share, recode and pivot step by step; an unused code becomes zero."""
    surveyed = survey(spark, sf_dir).na.drop(subset=["ground_cover"])
    shares = count_categories(surveyed, "plot_id", "ground_cover").withColumn("share", share_of_group("n", ["plot_id"]))
    named = shares.withColumn("ground_cover", recode("ground_cover", {k: f"kind_{k}" for k in _KINDS})).drop("n")
    columns = [f"kind_{k}" for k in _KINDS]
    return fill_zero(to_wide(named, "plot_id", "ground_cover", "share", columns, fill=None), columns)


@query(f"""WITH sums AS (SELECT l_returnflag, sum(l_quantity) AS quantity, max(l_extendedprice) AS price
  FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, 'quantity' AS term, {rounded_sql("quantity", 2)} AS estimate FROM sums
UNION ALL SELECT l_returnflag, 'price' AS term, {rounded_sql("price", 2)} AS estimate FROM sums""")
def unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price")
    )
    return round_all(to_long(sums, ["l_returnflag"], ["quantity", "price"]), 2)


@query(f"""WITH {SURVEY_SQL},
codes AS (SELECT plot_id, unnest([lf1, lf2, overstory1]) AS cover, unnest([1, 2, 3]) AS layer FROM survey)
SELECT plot_id, cover, nullif(count(*) FILTER (layer = 1), 0) AS first, nullif(count(*) FILTER (layer = 2), 0) AS second,
  nullif(count(*) FILTER (layer = 3), 0) AS over FROM codes GROUP BY ALL""")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of three layers side by side, from one scan and one shuffle."""
    return count_layers(survey(spark, sf_dir), "plot_id", {"first": "lf1", "second": "lf2", "over": "overstory1"})


@query("""SELECT user_id % 9 AS site, event_id, cents, sum(cents) OVER w::BIGINT AS total, count(cents) OVER w AS seen, min(cents) OVER w AS low,
  max(ts) OVER w AS last_ts, lead(cents) OVER (PARTITION BY user_id % 9 ORDER BY ts, event_id) AS next_cents
FROM (SELECT *, CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS cents FROM events)
WINDOW w AS (PARTITION BY user_id % 9 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals, counts and bounds and the next value of long series, which are cut into slices."""
    cents = F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("bigint"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("site"), "event_id", "ts", cents.alias("cents"))
    running = {"total": ("sum", "cents"), "seen": ("count", "cents"), "low": ("min", "cents"), "last_ts": ("max", "ts")}
    return ordered_scan(rows, ["site"], ["ts", "event_id"], running, ["cents"], max_rows=500).drop("ts")


@query(f"""SELECT l_orderkey, l_linenumber, {rounded_sql("l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_returnflag)", 9)} AS share
FROM lineitem""")
def row_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each raw row in a large group; rows stay where they are."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    shares = with_share(rows, "l_extendedprice", ["l_returnflag"])
    return round_all(shares.select("l_orderkey", "l_linenumber", "share"), 9)
