"""Reading, writing, column operations, filters and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsurvey.checks.fits import GRADES_SQL
from fieldsurvey.checks.registry import query
from fieldsurvey.checks.views import (
    REPLICATES_SQL,
    SEVERITY_CASE,
    SURVEY_SQL,
    location_key,
    location_key_sql,
    readings,
    readings_sql,
    replicates,
    survey,
    table,
)
from fieldsurvey.functions.hydrology import HydraulicParams
from fieldsurvey.functions.values import band, flag, parse_date, parse_logical, parse_number
from fieldsurvey.functions.values import recode, row_median as median_cells, row_sum as sum_cells, to_number
from fieldsurvey.operators.frames import (
    fill_text,
    fill_zero,
    lookup,
    null_negative as drop_negative,
    null_where,
    relocate_first,
    split_key as split_column,
    with_params,
)
from fieldsurvey.scratch import new_table_path
from fieldsurvey.sources.delimited import read_codes, read_table, write_table
from fieldsurvey.study import KEY_PARTS, SEVERITY_BOUNDS, SEVERITY_ELSE, grade_default, grade_table


@query("""SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_size::DOUBLE AS p_size,
  p_retailprice FROM part""")
def scan_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text file of the table read back by compact specification."""
    path = new_table_path(spark, "part")
    write_table(table(spark, sf_dir, "part"), path)
    return read_table(spark, path, compact="nc--nn")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 >= 3 THEN c_mktsegment END AS c_mktsegment,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer""")
def csv_missing_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL, empty text and the written token all come back as NULL."""
    case = F.col("c_custkey") % 5
    segment = F.when(case == 1, "").when(case == 2, "NA").when(case >= 3, F.col("c_mktsegment"))
    path = new_table_path(spark, "customer")
    customers = table(spark, sf_dir, "customer").select("c_custkey", segment.alias("c_mktsegment"), "c_acctbal")
    write_table(drop_negative(customers, ["c_acctbal"]), path)
    schema = T.StructType().add("c_custkey", "long").add("c_mktsegment", "string").add("c_acctbal", "double")
    return read_table(spark, path, schema=schema)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ', "' || p_type || '" twice' WHEN 1 THEN 'C:\\' || p_name || '\\'
    WHEN 2 THEN '"' || p_brand ELSE p_name || '|' || p_type || '"",' END AS note, p_retailprice FROM part""")
def csv_quoted_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, separators and backslashes in text come back as they were."""
    nth, quote, back = F.col("p_partkey") % 4, F.lit('"'), F.lit("\\")
    note = (
        F.when(nth == 0, F.concat("p_name", F.lit(", "), quote, "p_type", quote, F.lit(" twice")))
        .when(nth == 1, F.concat(F.lit("C:"), back, "p_name", back))
        .when(nth == 2, F.concat(quote, "p_brand"))
        .otherwise(F.concat("p_name", F.lit("|"), "p_type", quote, quote, F.lit(",")))
    )
    path = new_table_path(spark, "part")
    parts = table(spark, sf_dir, "part").select("p_partkey", note.alias("note"), "p_retailprice")
    write_table(parts, path)
    return read_table(spark, path, schema=T.StructType().add("p_partkey", "long").add("note", "string").add("p_retailprice", "double"))


@query("""SELECT o_orderkey, regexp_extract(o_orderpriority, '[0-9]+')::DOUBLE AS priority,
  (o_orderkey * 1000)::DOUBLE AS grouped,
  TRY_CAST(o_orderpriority AS DOUBLE) AS not_a_number,
  CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_open,
  o_orderdate::DATE AS order_date, NULL::DATE AS not_a_date FROM orders""")
def lenient_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        parse_number("o_orderpriority").alias("priority"),
        parse_number(F.concat(F.lit("nr "), F.col("o_orderkey"), F.lit(",000"))).alias("grouped"),
        to_number("o_orderpriority").alias("not_a_number"),
        parse_logical(F.get(F.array(F.lit("T"), F.lit(" false "), F.lit("maybe")), (F.col("o_orderkey") % 3).cast("int"))).alias("is_open"),
        parse_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        parse_date(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13-45"))).alias("not_a_date"),
    )


@query("""SELECT event_type AS code, 'type ' || event_type AS name, count(*) AS n
FROM events GROUP BY event_type""")
def code_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code list with carriage-return line ends, joined to the counts of its codes."""
    events = table(spark, sf_dir, "events")
    path = new_table_path(spark, "codes")
    codes = events.select(F.col("event_type").alias("code")).distinct()
    codes.withColumn("name", F.concat(F.lit("type "), "code")).write.csv(path, header=True, lineSep="\r")
    counts = events.groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"))
    return lookup(counts, read_codes(spark, path), "code").select("code", "name", "n")


@query("""SELECT l_shipdate, l_orderkey AS order_id, l_linenumber,
  l_extendedprice * (1 - l_discount) AS revenue,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
  'sandy loam' AS soil_texture_mdi, 1.89::DOUBLE AS n, 0.025::DOUBLE AS theta_i_cm3_cm3,
  0.41::DOUBLE AS theta_s_cm3_cm3, 2.25::DOUBLE AS mdiradius_cm, 0.075::DOUBLE AS alpha_percm,
  -1::DOUBLE AS tension_cm FROM lineitem""")
def computed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that build on each other, then drop, rename, literals and reorder."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
    )
    rows = rows.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    rows = rows.withColumn("charge", F.col("revenue") * (1 + F.col("l_tax")))
    rows = rows.drop("l_extendedprice", "l_discount", "l_tax").withColumnsRenamed({"l_orderkey": "order_id"})
    return relocate_first(with_params(rows, HydraulicParams()), ["l_shipdate", "order_id"])


@query(f"""WITH {readings_sql()}
SELECT location_id, event_id, time_sec FROM readings WHERE time_sec > 24""")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).filter(F.col("time_sec") > 24).select("location_id", "event_id", "time_sec")


@query(f"WITH {SURVEY_SQL} SELECT plot_id, event_id FROM survey WHERE ground_cover = 'click'")
def equal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).filter(F.col("ground_cover") == "click").select("plot_id", "event_id")


@query(f"WITH {SURVEY_SQL} SELECT plot_id, event_id, ground_cover FROM survey WHERE ground_cover IS NOT NULL")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).na.drop(subset=["ground_cover"]).select("plot_id", "event_id", "ground_cover")


@query(f"WITH {SURVEY_SQL} SELECT plot_id, event_id, ground_cover FROM survey WHERE ground_cover <> 'click'")
def not_equal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values are dropped together with the excluded one."""
    return survey(spark, sf_dir).filter(F.col("ground_cover") != "click").select("plot_id", "event_id", "ground_cover")


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
  nullif(c_nationkey, 0) AS c_nationkey FROM customer""")
def null_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return null_where(drop_negative(customers, ["c_acctbal"]), ["c_nationkey"], lambda c: c == 0)


@query(f"""WITH {SURVEY_SQL}
SELECT event_id, coalesce(lf1, '') AS lf1, coalesce(lf2, '') AS lf2,
  CASE ground_cover WHEN 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS clicks FROM survey""")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir).select(
        "event_id", "lf1", "lf2", F.when(F.col("ground_cover") == "click", 1.0).alias("clicks")
    )
    return fill_zero(fill_text(rows, ["lf1", "lf2"]), ["clicks"])


@query(f"""SELECT {SEVERITY_CASE.format("p_size")} AS severity, count(*) AS n FROM
(SELECT nullif(p_size, 13) AS p_size FROM part) GROUP BY 1""")
def band_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.nullif("p_size", F.lit(13))
    severity = band(size, SEVERITY_BOUNDS, SEVERITY_ELSE).alias("severity")
    return table(spark, sf_dir, "part").groupBy(severity).agg(F.count("*").alias("n"))


@query(f"""WITH {SURVEY_SQL}
SELECT plot_id, avg(CASE WHEN overstory1 <> 'no live' THEN 1 ELSE 0 END) AS live_share,
  count(overstory1) AS coded FROM survey GROUP BY plot_id""")
def flag_default_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = flag(F.col("overstory1") != "no live").cast("double")
    return survey(spark, sf_dir).groupBy("plot_id").agg(
        F.avg(live).alias("live_share"), F.count("overstory1").alias("coded")
    )


@query(f"""WITH {GRADES_SQL},
keyed AS (SELECT c_custkey, c_custkey % 12 + 1 AS plot_id, {location_key_sql("c_custkey")} AS location_id FROM customer)
SELECT location_id, c_custkey, CASE WHEN plot_id < 10 THEN 'good' ELSE g.ci_fit END AS ci_fit,
  CASE WHEN plot_id < 10 THEN 'good' ELSE g.cl_fit END AS cl_fit,
  CASE WHEN plot_id < 10 THEN 'good' ELSE g.dl_fit END AS dl_fit
FROM keyed LEFT JOIN grades g USING (location_id)""")
def quality_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "customer").select(location_key("c_custkey").alias("location_id"), "c_custkey")
    return lookup(keyed, grade_table(spark), "location_id", grade_default(F.col("c_custkey") % 12 + 1))


@query("""SELECT event_id, CASE t WHEN 'click' THEN 'touch' WHEN 'view' THEN 'look' ELSE t END AS kind
FROM (SELECT event_id, nullif(event_type, 'signup') AS t FROM events)""")
def recode_keep_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = recode(F.nullif("event_type", F.lit("signup")), {"click": "touch", "view": "look"})
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))


@query("""SELECT l_orderkey || '_' || l_linenumber AS location_id, l_orderkey::DOUBLE AS plot_id,
  l_linenumber::VARCHAR AS x_m, NULL::VARCHAR AS y_m FROM lineitem""")
def split_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("location_id")
    )
    return split_column(keys, "location_id", KEY_PARTS).withColumn("plot_id", to_number("plot_id"))


@query(f"""WITH {REPLICATES_SQL}
SELECT l_orderkey, CASE WHEN r1 IS NULL THEN (r2 + r3) / 2 ELSE list_sort([r1, r2, r3])[2] END + 0.0::DOUBLE AS mid
FROM replicates""")
def row_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = median_cells("r1", "r2", "r3") + F.lit(0.0)
    return replicates(spark, sf_dir).select("l_orderkey", mid.alias("mid"))


@query(f"WITH {REPLICATES_SQL} SELECT l_orderkey, r1 AS mid FROM replicates")
def row_median_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = median_cells("r1", "r2", "r3", mode="first")
    return replicates(spark, sf_dir).select("l_orderkey", mid.alias("mid"))


@query(f"""WITH {REPLICATES_SQL}
SELECT l_orderkey, coalesce(r1, 0) + r2 + r3 AS total, r1 + r2 AS strict_total FROM replicates""")
def row_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum with missing left out, and plain addition in which missing wins."""
    return replicates(spark, sf_dir).select(
        "l_orderkey", sum_cells("r1", "r2", "r3").alias("total"), (F.col("r1") + F.col("r2")).alias("strict_total")
    )
