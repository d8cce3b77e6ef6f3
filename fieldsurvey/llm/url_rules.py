"""Allow and block rules on URLs, by a sort-merge range join.

A key is the host written backwards by labels, each with a closing dot, then the path:
``www.example.com`` and ``/en/1`` give ``com.example.www./en/1``. A rule covers the
interval of keys that begin with its own. A rule fits subdomains too, whose keys have
more labels before the path; so a URL probes once for every level of its host that a rule has:
``com./en/1``, ``com.example./en/1``, ``com.example.www./en/1``. Rules and probes are
range-partitioned and sorted together, and one sweep over each partition keeps a stack
of the rules whose intervals are open, outer ones below; the top is the longest rule of
that probe. Probes of a hot host differ in further sort columns and are dealt over many
partitions. Rules still open where a partition begins are prefixes of its first key:
they are found by one small join and put on its stack, at most one for each length that
a rule's key has. Keys are cut to the length of the longest rule's key, which changes no answer, so what a
long URL costs depends on the labels and lengths of the rules and grows with its own length only once.

Defined results: a NULL URL or one without ``://`` has empty host and path and no rule;
an empty host or path is fitted by no rule that has a host or path; repeated URLs are
judged alike; a URL of any length, with any number of labels, is judged whole; repeated
rules count once, and of equal rules with both verdicts blocking wins; of rules equally long the one with the longer host wins; a rule with a NULL is an
error; without rules all get the default; other columns pass through, those named like
an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsurvey.skew import fixed

ALLOW, BLOCK = "allow", "block"
OUTPUTS = ("host", "path", "rule", "verdict")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path as written, both empty without ``://``."""
    at = F.position(F.lit("://"), url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    """Labels of the host, outermost first."""
    return F.reverse(F.split(host, r"\.", -1))


def _written(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


def rule_table(rules: DataFrame) -> DataFrame:
    """One row for each host and path: key, text of the rule, verdict, length of host."""
    named = {c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a rule has no {c}"))) for c in ("host", "path", "verdict")}
    rows = rules.select(*[e.alias(c) for c, e in named.items()]).withColumn("host", lower_ascii(F.col("host")))
    once = rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return once.select(
        F.concat(_written(_labels(F.col("host"))), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict",
        F.char_length("host").alias("host_length"), F.size(_labels(F.col("host"))).alias("labels"),
    )


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (host and path of the rule, or NULL) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``.
    """
    spark = df.sparkSession
    host, path = host_and_path(F.col(url))
    own = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in OUTPUTS]
    rows = df.select(
        F.struct(*own, host.alias("host"), path.alias("path")).alias("own"), F.monotonically_increasing_id().alias("nth")
    )
    table = rule_table(rules)
    # Levels that have rules and lengths of the rules' keys: as many as the most labels and the longest key at most.
    levels, lengths = table.agg(
        F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set(F.char_length("key")))
    ).first()
    longest = lengths[-1] if lengths else 1
    # The row itself travels once, with a probe that no rule fits if no level of it has rules.
    used = rows.withColumn("labels", F.slice(_labels(F.col("own.host")), 1, max(levels or [1])))
    at = F.filter(F.array(*map(F.lit, levels or [0])), lambda n: (n > 0) & (n <= F.size("labels")))
    probes = used.select(
        "own", "nth", "labels", F.posexplode(F.when(F.size(at) > 0, at).otherwise(F.array(F.lit(0)))).alias("above", "level"),
    ).select(
        F.when(F.col("level") > 0, F.substring(
            F.concat(_written(F.slice("labels", F.lit(1), F.col("level"))), F.substring("own.path", 1, longest)), 1, longest
        )).otherwise("").alias("key"),
        F.lit(1).alias("kind"), "nth", F.when(F.col("above") == 0, F.col("own")).alias("own"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("rule", "string"), ("verdict", "string"), ("host_length", "int"))],
    )
    opened = table.select(
        "key", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("nth"), F.lit(None).cast(probes.schema["own"].dataType).alias("own"),
        "rule", "verdict", "host_length",
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        probes.unionByName(opened)
        .repartitionByRange(partitions, "key", "kind", "nth").sortWithinPartitions("key", "kind", "nth")
        .withColumn("part", F.spark_partition_id())
    )
    # All steps below must see the same partitions.
    ordered = fixed(ordered)
    found = _swept(ordered, _open_at_start(ordered, table, lengths))
    best = found.groupBy("nth").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.char_length("rule"), "host_length", "verdict", "rule"))).alias("best"),
        F.max_by("own", F.col("own").isNotNull()).alias("own"),
    )
    return best.select("own.*", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _open_at_start(ordered: DataFrame, table: DataFrame, lengths: list[int]) -> dict[int, list[tuple]]:
    """Rules open at the first key of each partition, outermost first.

    One row for each partition and length of a rule's key, whatever the number of rules.
    """
    first = ordered.groupBy("part").agg(F.min("key").alias("first"))
    fitting = F.filter(F.array(*map(F.lit, lengths or [0])), lambda n: n <= F.char_length("first"))
    prefixes = first.select("part", F.explode(F.transform(fitting, lambda n: F.substring("first", F.lit(1), n))).alias("key"))
    rows = prefixes.join(table, "key").collect()
    stacks: dict[int, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: len(r.key)):
        stacks.setdefault(r.part, []).append((r.key, r.rule, r.verdict, r.host_length))
    return stacks


def _swept(ordered: DataFrame, stacks: dict[int, list[tuple]]) -> DataFrame:
    """Probes with the innermost open rule."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if stack is None:
                stack = list(stacks.get(batch.column("part")[0].as_py(), ()))
            keys, kinds = batch.column("key").to_pylist(), batch.column("kind").to_pylist()
            own = [batch.column(c).to_pylist() for c in ("rule", "verdict", "host_length")]
            found: list[tuple] = []
            for row, key in enumerate(keys):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kinds[row] == 0:
                    stack.append((key, *(c[row] for c in own)))
                else:
                    found.append(stack[-1][1:] if stack else (None, None, None))
            probes = batch.filter(pa.array(np.array(kinds) == 1))
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [probes.column("nth"), probes.column("own"), *columns], ["nth", "own", "rule", "verdict", "host_length"]
            )

    schema = T.StructType([ordered.schema[c] for c in ("nth", "own", "rule", "verdict", "host_length")])
    return ordered.mapInArrow(task, schema)
