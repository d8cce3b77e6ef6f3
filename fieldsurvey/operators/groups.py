"""Counts and summaries per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsurvey.functions.aggregates import mean_, representative
from fieldsurvey.functions.values import col
from fieldsurvey.operators.reshape import to_long


def as_keys(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def category_counts(df: DataFrame, by: str | Sequence[str], cat: str, name: str = "n") -> DataFrame:
    """Rows per group and category; missing is a category of its own."""
    return df.groupBy(*as_keys(by), cat).agg(F.count("*").alias(name))


def layer_counts(df: DataFrame, by: str | Sequence[str], layers: Mapping[str, str], cat: str = "cover") -> DataFrame:
    """Rows per group and category of several layers side by side, from one scan.

    ``layers`` maps the new count to the column of its layer. The layers of a row are stacked and counted by where they
    came from, which gives the rows of a full outer merge of one count for each layer: NULL where a layer lacks the
    category, and missing as a category of its own.
    """
    keys = as_keys(by)
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("layer"), col(c).alias(cat)) for name, c in layers.items()])).alias("_code")
    counts = [F.nullif(F.count_if(F.col("layer") == name), F.lit(0)).alias(name) for name in layers]
    return df.select(*keys, stacked).select(*keys, "_code.*").groupBy(*keys, cat).agg(*counts)


def group_representative(df: DataFrame, by: str | Sequence[str], c: str) -> DataFrame:
    """The one value of ``c`` per group; an error where there are several."""
    keys = as_keys(by)
    return df.select(*keys, c).distinct().groupBy(*keys).agg(representative(c).alias(c))


def quality_sensitivity(df: DataFrame, by: str, measures: Sequence[str], grade: str) -> DataFrame:
    """Group means under three rules for graded rows, in one pass.

    ``drop_poor`` leaves out poor and ungraded rows, ``keep_all`` uses all rows,
    ``only_good`` uses good rows. A group with no row under a rule is left out.
    """
    rules = {
        "drop_poor": F.col(grade) != "poor",
        "keep_all": F.lit(True),
        "only_good": F.col(grade) == "good",
    }
    cells = []
    for name, rule in rules.items():
        means = [mean_(F.when(rule, col(m))).alias(f"mean_{m}") for m in measures]
        cells.append(F.struct(F.count_if(rule).alias("_rows"), *means).alias(name))
    long = to_long(df.groupBy(by).agg(*cells), [by], list(rules), "variant", "_cell")
    return long.filter("_cell._rows > 0").select(by, "variant", "_cell.*").drop("_rows")
