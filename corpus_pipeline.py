"""A corpus pipeline: quality, near duplicates, benchmark leaks, secrets, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the stage
before kept; results are written as Parquet and read again between stages.

Defined results: NULL texts are scored, linked and encoded as empty ones; documents
without an id are kept by the near-duplicate stage, since no group can name them; rows
that share an id and a text there count as one document, rows that share only an id are
documents of their own; empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsurvey.llm import bpe, jaccard, leaks, quality, secrets
from fieldsurvey.llm.blocks import stored
from fieldsurvey.llm.queries import RANKS, digests, fold, table

#: Batches between the engine and Python workers, by rows and by bytes: texts can be long, and a worker and the
#: engine hold some batches each. Each setting with the default that it replaces; a session that sets a
#: number keeps its own. They stay set, since stages run after their function has returned.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "1048576b"),
}
#: A document stays with at least this probability of good quality.
KEEP = 0.5


def _small_batches(spark: SparkSession) -> None:
    for name, (usual, small) in BATCHES.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, small)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    _small_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(fold(3) != 1)
    scored = quality.classify(docs, labels, out="__score", keep_text=True)
    return scored.filter(F.col("__score") >= KEEP).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, of several texts with that id one."""
    _small_batches(spark)
    # An id may stand on several rows: a row is known by its id and its text.
    row = ["doc_id", "__print"]
    printed = docs.withColumn("__print", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    found = jaccard.classes(printed.select(F.when(F.col("doc_id").isNotNull(), F.struct(*row)).alias("row"), "text"), key="row")
    kept = found.filter("row = component_id").select("row.*")
    named = printed.join(kept, row, "left_semi").dropDuplicates(row).drop("__print")
    return named.unionByName(docs.filter("doc_id IS NULL")).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    _small_batches(spark)
    found = leaks.find(docs, table(spark, sf_dir, "benchmark"), out="__leaks")
    return found.filter(F.size("__leaks") == 0).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    found = secrets.scan(docs, spans="__spans", keep_text=True)
    text = secrets.masked(F.col("text"), F.col("__spans"))
    length = F.when(F.size("__spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("text", text).withColumn("n_chars", length).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests that show that they decode to its text."""
    _small_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, decoded="decoded", keep_text=False)
    return digests(coded, "ids")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("token_ids", token_ids),
]

#: No stage but the last has an equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
