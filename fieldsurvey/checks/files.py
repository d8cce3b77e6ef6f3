"""Files with damaged lines or other headers, and the three runs from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsurvey.checks.registry import SQL, query, round_all
from fieldsurvey.checks.tables import stage_sources
from fieldsurvey.checks.views import DROP_TIMES, table
from fieldsurvey.functions.hydrology import HydraulicParams
from fieldsurvey.plans.staged import run_pipeline
from fieldsurvey.scratch import new_table_path
from fieldsurvey.sources.delimited import read_checked, read_table, write_table


@query("""SELECT kind, count(*) AS n, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM (
  SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN '3 fields expected, 2 found' WHEN 2 THEN '3 fields expected, 4 found'
    WHEN 3 THEN 'quote left open' ELSE 'row' END AS kind FROM orders
  UNION ALL SELECT o_orderkey, 'not a number' FROM orders WHERE o_orderkey % 7 = 4
  UNION ALL SELECT o_orderkey, 'not a date' FROM orders WHERE o_orderkey % 7 = 4 AND o_orderkey % 5 = 0)
GROUP BY kind""")
def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read past damaged lines, and what was wrong with how many."""
    damage, path = F.col("o_orderkey") % 7, new_table_path(spark, "damaged")
    key = F.col("o_orderkey").cast("string")
    price = F.when(damage == 4, F.concat(F.lit("unknown "), F.lit("price"))).otherwise(F.col("o_totalprice").cast("string"))
    day = F.when((damage == 4) & (F.col("o_orderkey") % 5 == 0), F.lit("soon")).otherwise(F.lit("2020-07-13"))
    # The key comes in quotes, with a comma and a doubled quote, so that fields can't be told by commas.
    name = F.concat(F.lit('"no ""'), key, F.lit('"", '), key, F.lit('"'))
    line = (
        F.when(damage == 1, F.concat_ws(",", name, price))
        .when(damage == 2, F.concat_ws(",", name, price, day, F.lit("more")))
        .when(damage == 3, F.concat(F.lit('"no ""'), key, F.lit('"", '), key))
        .otherwise(F.concat_ws(",", name, price, day))
    )
    table(spark, sf_dir, "orders").select(line.alias("name,price,day")).write.csv(path, header=True, quote="", escape="", sep="\u0001")
    schema = T.StructType().add("name", "string").add("price", "double").add("day", "date")
    checked = read_checked(spark, path, schema)
    rows = checked.rows.select(F.lit("row").alias("kind"), F.col("name").alias("text"))
    # A cell is no line, so its order is read from the row that it stands in.
    wrong = checked.problems.filter("column IS NULL").select(F.col("reason").alias("kind"), "text")
    cells = checked.problems.filter("column IS NOT NULL").groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("n"))
    order = F.regexp_extract("text", r'no "+(\d+)', 1).cast("bigint")
    found = rows.unionByName(wrong).groupBy("kind").agg(F.count("*").alias("n"), F.min(order).alias("first_order"), F.max(order).alias("last_order"))
    late = checked.rows.filter("price IS NULL").select("day", F.regexp_extract("name", r'no "(\d+)', 1).cast("bigint").alias("o"))
    ends = F.min("o").alias("first_order"), F.max("o").alias("last_order")
    spread = late.agg(*ends).select(F.lit("not a number").alias("kind"), "*").unionByName(
        late.filter("day IS NULL").agg(*ends).select(F.lit("not a date").alias("kind"), "*")
    )
    return found.unionByName(cells.join(spread, "kind"))


@query("""SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderpriority, o_totalprice FROM orders""")
def csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups of files with their columns in other orders, read alike."""
    orders = table(spark, sf_dir, "orders")
    names = {"o_orderkey": "O.orderkey", "o_orderpriority": "O.orderpriority", "o_totalprice": "O.totalprice"}
    paths = []
    for i, columns in enumerate([[0, 1, 2], [2, 0, 1], [1, 2, 0]]):
        paths.append(new_table_path(spark, f"orders-{i}"))
        write_table(orders.filter(F.col("o_orderkey") % 3 == i).select(*[list(names)[c] for c in columns]), paths[-1], names=names)
    return read_table(spark, paths, compact="ncn", names=list(names), by_name=True)


def source_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The sources of the staged run as delimited files with all columns of their specification."""
    frames = stage_sources(spark, sf_dir)
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    skipped = none(*[f"skip{i}" for i in range(4)])
    tables = {
        "readings": frames["readings"].select(
            F.lit("2020-07-13").alias("date"), "location_id", *none("f1", "f2", "n1"), "time_sec", *none("n2"), "i_cm", *none("n3")
        ),
        "survey": frames["survey"].select(
            "location_id", *skipped, *[f"wd_{d}cm_{r}_sec" for d, r in DROP_TIMES], "wd_4cm_hydrophobic", "wd_5cm_hydrophobic",
            "litter_depth_cm", "theta_i_percent", "ground_cover", "lf1", "lf2", *none("lf3"), "overstory1", "overstory2", *none("remark"),
        ),
        "density": frames["density"].select("location_id", *skipped, "bulk_density_gcm3", *none(*[f"more{i}" for i in range(10)])),
        "soil": frames["soil"].select(
            "location_id", *skipped, *none("soil_texture_class"), "sand_percent", "silt_percent", "clay_percent",
            "total_organic_carbon_percent", "total_nitrogen_percent", *none("s", "c", "notes"),
        ),
    }
    paths = {name: new_table_path(spark, f"{name}-files") for name in tables}
    for name, df in tables.items():
        write_table(df, paths[name])
    return paths


@query(SQL["staged_tables"])
def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three runs from delimited files to stage tables and exports."""
    tables = run_pipeline(spark, source_files(spark, sf_dir), HydraulicParams(), new_table_path(spark, "run"))
    return round_all(tables["plot_summary"])
