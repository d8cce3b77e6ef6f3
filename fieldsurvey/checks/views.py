"""Field-survey shaped views of the test tables, in Spark and in SQL.

``readings`` is a cumulative time series per location, ``survey`` holds cover
codes per point and ``full`` has the columns of a merged site table. All are
made of ``events``; ``replicates`` is made of ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsurvey.operators.ordered import SLICE, slice_heavy_groups, with_running

MICROS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def location_key(number: Column | str) -> Column:
    """A key ``plot_x_y`` unique per number."""
    n = F.col(number) if isinstance(number, str) else number
    return F.concat_ws("_", n % 12 + 1, F.floor(n / 12) % 11, F.floor(n / 132))


def location_key_sql(n: str) -> str:
    return f"concat_ws('_', {n} % 12 + 1, ({n} // 12) % 11, {n} // 132)"


def readings(spark: SparkSession, sf_dir: str, key: Column | None = None) -> DataFrame:
    """location_id, event_id, ts, time_sec since the first event, i_cm running total.

    Heavy locations come out sliced (see ``operators.ordered``), with the number of
    the slice in ``_slice``.
    """
    by, order = ["location_id"], ["ts", "event_id"]
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") if key is None else key).alias("location_id"),
        "event_id",
        "ts",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    rows = slice_heavy_groups(rows, by, order)
    rows = with_running(rows, by, order, {"start": ("min", "ts"), "total": ("sum", "cents")})
    elapsed = F.timestamp_diff("MICROSECOND", F.col("start"), F.col("ts"))
    return rows.select(
        "location_id",
        "event_id",
        "ts",
        (elapsed.cast("double") / F.lit(float(MICROS))).alias("time_sec"),
        (F.col("total").cast("double") / F.lit(100.0)).alias("i_cm"),
        SLICE,
    )


def readings_sql(key: str = "user_id") -> str:
    return f"""
keyed AS (
  SELECT {key} AS location_id, event_id, ts, epoch_us(ts) AS us,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events),
readings AS (
  SELECT location_id, event_id,
         CAST(us - min(us) OVER (PARTITION BY location_id) AS DOUBLE) / 1e6 AS time_sec,
         CAST(sum(cents) OVER (PARTITION BY location_id ORDER BY ts, event_id
                               ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e2 AS i_cm
  FROM keyed)"""


def _pick(number: Column, *codes: str | None) -> Column:
    """Code number ``number``; NULL beyond the list."""
    return F.get(F.array(*[F.lit(c) for c in codes]), number.cast("int"))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plot_id, event_id and cover codes in layers, with missing ones."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 12 + 1).alias("plot_id"),
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("ground_cover"),
        _pick(n % 5, "F", "G", "L", "T").alias("lf1"),
        _pick(n % 7, "F", "WD", "G").alias("lf2"),
        _pick(n % 4, "PSME", "PIPO", "no live").alias("overstory1"),
        _pick(n % 6, "QUGA").alias("overstory2"),
    )


SURVEY_SQL = """
survey AS (
  SELECT user_id % 12 + 1 AS plot_id, event_id, nullif(event_type, 'error') AS ground_cover,
         CASE event_id % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'G' WHEN 2 THEN 'L' WHEN 3 THEN 'T' END AS lf1,
         CASE event_id % 7 WHEN 0 THEN 'F' WHEN 1 THEN 'WD' WHEN 2 THEN 'G' END AS lf2,
         CASE event_id % 4 WHEN 0 THEN 'PSME' WHEN 1 THEN 'PIPO' WHEN 2 THEN 'no live' END AS overstory1,
         CASE event_id % 6 WHEN 0 THEN 'QUGA' END AS overstory2
  FROM events)"""


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three measurements per row, the first with missing values."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.nullif("l_quantity", F.lit(25.0)).alias("r1"),
        (F.col("l_discount") * 100).alias("r2"),
        (F.col("l_tax") * 100).alias("r3"),
    )


REPLICATES_SQL = """
replicates AS (
  SELECT l_orderkey, nullif(l_quantity, 25) AS r1, l_discount * 100 AS r2, l_tax * 100 AS r3
  FROM lineitem)"""

GROUND_LIST = ("B", "F", "L", "G", "R", "SD", "WD", "D", "M", "T")
DROP_TIMES = [(depth, replicate) for depth in range(4) for replicate in range(1, 4)]


def survey_points(spark: SparkSession, sf_dir: str, key: Column | None = None) -> DataFrame:
    """Survey rows with all measurements, one per event, keyed by location.

    ``key`` stands in for the location. Ground cover is missing for one event type; canopy and overstory codes have
    blanks where ``survey`` has NULL.
    """
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        location_key("user_id").alias("location_id") if key is None else key,
        *[
            F.nullif((n + 5 * depth + 3 * replicate * replicate) % 17, F.lit(0)).cast("double").alias(f"wd_{depth}cm_{replicate}_sec")
            for depth, replicate in DROP_TIMES
        ],
        F.when(n % 3 != 0, n % 2 == 0).alias("wd_4cm_hydrophobic"),
        F.when(n % 5 != 0, n % 7 < 2).alias("wd_5cm_hydrophobic"),
        F.col("value").alias("litter_depth_cm"),
        F.when(n % 11 != 0, F.col("value") / 4).alias("theta_i_percent"),
        F.when(F.col("event_type") != "error", _pick(n % 10, *GROUND_LIST)).alias("ground_cover"),
        _pick(n % 5, "F", "G", "L", "T", "").alias("lf1"),
        _pick(n % 7, "F", "WD", "G", "SD").alias("lf2"),
        _pick(n % 4, "PSME", "PIPO", "no live", "").alias("overstory1"),
        _pick(n % 6, "QUGA").alias("overstory2"),
    )


_TIMES_SQL = ",\n".join(
    f"         nullif((event_id + {5 * d + 3 * r * r}) % 17, 0)::DOUBLE AS wd_{d}cm_{r}_sec"
    for d, r in DROP_TIMES
)
_GROUND_SQL = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(GROUND_LIST))

# Blanks are missing for the summary, so the SQL has NULL in their place.
POINTS_SQL = f"""
points AS (
  SELECT {location_key_sql("user_id")} AS location_id, user_id, event_id, value,
{_TIMES_SQL},
         CASE WHEN event_id % 3 <> 0 THEN event_id % 2 = 0 END AS wd_4cm_hydrophobic,
         CASE WHEN event_id % 5 <> 0 THEN event_id % 7 < 2 END AS wd_5cm_hydrophobic,
         value AS litter_depth_cm,
         CASE WHEN event_id % 11 <> 0 THEN value / 4 END AS theta_i_percent,
         CASE WHEN event_type <> 'error' THEN CASE event_id % 10 {_GROUND_SQL} END END AS ground_cover,
         CASE event_id % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'G' WHEN 2 THEN 'L' WHEN 3 THEN 'T' END AS lf1,
         CASE event_id % 7 WHEN 0 THEN 'F' WHEN 1 THEN 'WD' WHEN 2 THEN 'G' WHEN 3 THEN 'SD' END AS lf2,
         CASE event_id % 4 WHEN 0 THEN 'PSME' WHEN 1 THEN 'PIPO' WHEN 2 THEN 'no live' END AS overstory1,
         CASE event_id % 6 WHEN 0 THEN 'QUGA' END AS overstory2
  FROM events)"""

SEVERITY_CASE = """CASE WHEN {0} IS NULL THEN NULL WHEN {0} < 4 THEN 'high' WHEN {0} < 7 THEN 'moderate'
  WHEN {0} < 10 THEN 'low' ELSE 'unburned' END"""
