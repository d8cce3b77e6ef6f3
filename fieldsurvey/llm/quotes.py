"""Conversations without quotations, in reply order.

Everything is Column and DataFrame code. Lines that begin with ``>`` marks are quoted;
the number of marks is the level. Lines of one level in a row are a passage. A passage
is normalised (lower case, white space runs as one space) and hashed, as a whole and by
line, and so are the unquoted lines, the paragraphs and the whole body of every message; line
breaks count as spaces, so that lines may be wrapped anew. The original
of a passage is the first message of the same conversation with that hash, if it came
earlier; a whole passage weighs more than any number of single lines. A message replies
to the original of its outermost quotation, else to the message before it.

Messages without a linked quotation follow the one before, so replies form runs of
turns; only the runs, not the messages, are followed upwards, by doubling the reach of
their links, to give each message its ``depth``. Rows in the order ``conv_id, depth,
turn`` have every message after the one that it replies to.

No step groups or sorts a conversation in one task: sums are made before rows are
shuffled, and the neighbour of a turn is found in range-partitioned slices.

Defined results: NULL text is an empty body; a NULL conversation or turn links to
nothing and has depth 0; rows that share conversation and turn get the same links, with
a body each; of equally good originals the earliest wins; quotations of nothing known
are removed from the body all the same; very long messages cost as much as their lines; an empty table gives an empty table; other
columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsurvey.llm.columns import bound, quoted, unused
from fieldsurvey.skew import fixed

MARKS = r"^ ?((?:> ?)+)"
OUTPUTS = ("body", "n_quoted", "n_linked", "reply_to", "depth")
#: Weight of a passage that equals a whole message or a run of its lines, against single lines.
WHOLE = 1_000_000


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 1)
    return F.char_length(marks) - F.char_length(F.replace(marks, F.lit(">"), F.lit("")))


def lines_of(text: Column) -> Column:
    """Lines with their quote level and their text without marks."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n", -1),
        lambda x: F.struct(quote_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")),
    )


def body_of(text: Column) -> Column:
    """Unquoted lines, without blank lines at either end."""
    value = F.coalesce(text, F.lit(""))
    own = F.filter(F.split(value, "\r?\n", -1), lambda x: quote_level(x) == 0)
    kept = F.regexp_replace(F.array_join(own, "\n"), r"^\s*\n|\s+$", "")
    return F.when(value.rlike(r"(?m)" + MARKS), kept).otherwise(value)


def passages(text: Column) -> Column:
    """Level and normalised lines of each run of quoted lines of one level."""

    def level(lines: Column, at: Column) -> Column:
        return F.get(lines, at)["level"]

    def begins(lines: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (level(lines, i) != level(lines, i - 1)))

    def cut(lines: Column, at: Column) -> Column:
        def run(start: Column, nth: Column) -> Column:
            own = F.slice(lines, start + 1, F.coalesce(F.get(at, nth + 1), F.size(lines)) - start)
            return F.struct(level(lines, start).alias("level"), F.transform(own, lambda x: x["line"]).alias("lines"))

        return F.transform(at, run)

    runs = bound(lines_of(text), lambda lines: bound(begins(lines), lambda at: cut(lines, at)))
    clean = F.transform(F.filter(runs, lambda r: r["level"] > 0), lambda r: F.struct(
        r["level"].alias("level"), F.filter(F.transform(r["lines"], normalised), lambda x: x != "").alias("lines")
    ))
    return F.filter(clean, lambda r: F.size(r["lines"]) > 0)


def _hash(c: Column) -> Column:
    return F.sha2(c, 256)


def _before(turns: DataFrame, group: str, order: str) -> DataFrame:
    """``turns`` (distinct) with the next smaller value of ``order`` in its group as ``before``.

    Slices of the sorted table are windows of their own; the first row of a slice takes
    the last row of the slice before it, from a table with one row for each slice.
    """
    spark = turns.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = fixed(
        turns.repartitionByRange(count, group, order).sortWithinPartitions(group, order).withColumn("part", F.spark_partition_id())
    )
    inside = Window.partitionBy("part").orderBy(group, order)
    lagged = sliced.withColumns({"_group": F.lag(group).over(inside), "_order": F.lag(order).over(inside), "_nth": F.row_number().over(inside)})
    # One row for each slice, in one window.
    ends = sliced.groupBy("part").agg(F.max(F.struct(group, order)).alias("end"))
    ends = ends.select((F.lead("part").over(Window.orderBy("part"))).alias("part"), "end").filter("part IS NOT NULL")
    joined = lagged.join(F.broadcast(ends), "part", "left")
    first = F.col("_nth") == 1
    near_group = F.when(first, F.col(f"end.{group}")).otherwise(F.col("_group"))
    near = F.when(first, F.col(f"end.{order}")).otherwise(F.col("_order"))
    return joined.select(group, order, F.when(near_group == F.col(group), near).alias("before"))


def thread(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``df`` with ``body``, ``n_quoted`` and ``n_linked`` passages, ``reply_to`` (a turn) and ``depth``."""
    keep = [quoted(c) for c in df.columns if c not in OUTPUTS]
    rows = df.select(*keep)
    key = (F.col(conversation).alias("c"), F.col(turn).alias("t"))
    known = rows.filter(F.col(conversation).isNotNull() & F.col(turn).isNotNull())
    parent = fixed(_parents(known.select(*key, F.col(text).alias("x"))))
    c, t = unused(df, "_c"), unused(df, "_t")
    links = _depths(parent).select(F.col("c").alias(c), F.col("t").alias(t), "n_linked", "reply_to", "depth")
    joined = rows.join(links, (F.col(conversation) == F.col(c)) & (F.col(turn) == F.col(t)), "left")
    return joined.select(
        *keep, body_of(F.col(text)).alias("body"), F.size(passages(F.col(text))).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def quotation_links(messages: DataFrame) -> DataFrame:
    """The original of each quoted passage: c, t, level, nth passage, origin.

    ``messages`` has c, t and x (text).
    """
    quoted = messages.filter(F.col("x").rlike(r"(?m)" + MARKS)).select("c", "t", F.posexplode(passages(F.col("x"))).alias("nth", "p"))
    whole = quoted.select("c", "t", "nth", "p.level", _hash(F.array_join("p.lines", " ")).alias("h"), F.lit(WHOLE).alias("weight"))
    single = quoted.select("c", "t", "nth", "p.level", F.explode("p.lines").alias("line")).select("c", "t", "nth", "level", _hash(F.col("line")).alias("h"), F.lit(1).alias("weight"))
    wanted = whole.unionByName(single).groupBy("c", "t", "nth", "level", "h").agg(F.max("weight").alias("weight"))
    own = F.filter(F.transform(F.split(body_of(F.col("x")), "\n", -1), normalised), lambda x: x != "")
    paragraphs = F.transform(F.split(body_of(F.col("x")), r"\n\s*\n", -1), normalised)
    pieces = F.array_distinct(F.concat(F.array(F.array_join(own, " ")), paragraphs, own))
    # Only conversations with quotations are searched; the first message with a hash is its original.
    with_quotes = quoted.select("c").distinct()
    first = (
        messages.join(with_quotes, "c", "left_semi").select("c", "t", F.explode(pieces).alias("piece")).filter(F.col("piece") != "")
        .select("c", "t", _hash(F.col("piece")).alias("h")).groupBy("c", "h").agg(F.min("t").alias("origin"))
    )
    votes = (
        wanted.join(first, ["c", "h"]).filter(F.col("origin") < F.col("t"))
        .groupBy("c", "t", "nth", "level", "origin").agg(F.sum("weight").alias("votes"))
    )
    best = votes.groupBy("c", "t", "nth", "level").agg(F.max(F.struct("votes", (-F.col("origin")).alias("back"))).alias("best"))
    return best.select("c", "t", "level", "nth", (-F.col("best.back")).alias("origin"))


def _parents(messages: DataFrame) -> DataFrame:
    links = quotation_links(messages)
    outer = links.groupBy("c", "t").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "nth", "origin")).alias("outer"))
    turns = _before(messages.select("c", "t").distinct(), "c", "t")
    joined = turns.join(outer, ["c", "t"], "left")
    return joined.select("c", "t", "before", "n_linked", F.coalesce("outer.origin", "before").alias("reply_to"))


def _depths(parent: DataFrame) -> DataFrame:
    """Number of messages above each one.

    A message that replies to the one before continues its run. Depth inside a run is
    the rank of the turn less that of the run's begin; runs are linked by doubling.
    """
    ranked = _rank(parent)
    begins = F.col("reply_to").isNull() | (F.col("reply_to") != F.col("before"))
    starts = ranked.filter(begins).select("c", F.col("t").alias("start"), F.col("rank").alias("start_rank"), "reply_to")
    if starts.filter(F.col("reply_to").isNotNull()).isEmpty():
        return ranked.withColumn("depth", F.col("rank"))
    # The run of a turn is the last start at or before it: starts and turns in one sorted pass.
    member = fixed(_last_start(ranked, starts))
    heads = member.filter(begins).select("c", F.col("t").alias("start"), "rank", "reply_to")
    place = member.select("c", F.col("t").alias("reply_to"), F.col("start").alias("up"), (F.col("rank") - F.col("start_rank") + 1).alias("step"))
    link = fixed(heads.join(place, ["c", "reply_to"], "left").select("c", "start", "up", F.coalesce("step", F.lit(0)).alias("above")))
    while not link.filter(F.col("up").isNotNull()).isEmpty():
        over = link.select("c", F.col("start").alias("up"), F.col("up").alias("next"), F.col("above").alias("more"))
        link = fixed(link.join(over, ["c", "up"], "left").select("c", "start", F.col("next").alias("up"), (F.col("above") + F.coalesce("more", F.lit(0))).alias("above")))
    joined = member.join(link.select("c", "start", "above"), ["c", "start"], "left")
    return joined.withColumn("depth", F.col("above") + F.col("rank") - F.col("start_rank"))


def _running(df: DataFrame, value: Column, name: str, combine: Callable, merge: Callable) -> DataFrame:
    """Running aggregate of ``value`` in each c by t, in slices that take over what came before."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = fixed(
        df.withColumn("_v", value).repartitionByRange(count, "c", "t").sortWithinPartitions("c", "t").withColumn("part", F.spark_partition_id())
    )
    inside = Window.partitionBy("part", "c").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    # At most one row for each slice goes on into the next: that of the slice's last c.
    sums = sliced.groupBy("part", "c").agg(combine("_v").alias("sum"))
    last = sums.groupBy("part").agg(F.max(F.struct("c", "sum")).alias("last"), F.min("c").alias("low"))
    so_far = Window.partitionBy("last.c").orderBy("part")
    carried = last.select("part", "low", F.col("last.c").alias("high"), combine("last.sum").over(so_far).alias("sum"))
    ahead = Window.orderBy("part")
    taken = carried.select("part", F.col("low").alias("c"), F.lag("high").over(ahead).alias("left"), F.lag("sum").over(ahead).alias("_before"))
    taken = taken.filter(F.col("c") == F.col("left")).drop("left")
    joined = sliced.withColumn("_run", combine("_v").over(inside)).join(F.broadcast(taken), ["part", "c"], "left")
    return joined.withColumn(name, merge(F.col("_before"), F.col("_run"))).drop("_v", "_run", "_before", "part")


def _rank(parent: DataFrame) -> DataFrame:
    """Rank of each turn in its conversation, from 0."""
    return _running(parent, F.lit(1), "rank", F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b - 1)


def _last_start(ranked: DataFrame, starts: DataFrame) -> DataFrame:
    begins = F.col("reply_to").isNull() | (F.col("reply_to") != F.col("before"))
    value = F.when(begins, F.struct("t", "rank"))
    out = _running(ranked, value, "_start", F.max, lambda a, b: F.greatest(a, b))
    return out.withColumns({"start": F.col("_start.t"), "start_rank": F.col("_start.rank")}).drop("_start")
