"""What filters remove alone, together and in every order of application.

A document is judged once; all that matters afterwards is its mask, the set of filters
that it fails. Masks are counted for each part of the corpus, so that at most ``2**n``
cells a part are left of any number of rows. One walk over all subsets of filters in Gray
code order turns one filter on or off at a time: every cell keeps the number of active
filters that it fails, and only cells whose number becomes or leaves zero move between the
running survivors and the rest. The survivors of the 32 subsets are stored; any step of any
order is the difference of two of them.

The duplicate filter is a fact of the whole table: texts are compared by their SHA-256. The
smallest id of a text is found by a minimum (which is made before rows are shuffled) and
joined back on text and id together, so that a group of copies is no hot key. Rows that agree
in all that is looked at are counted together before they move.

Defined results: a NULL text is empty and equal to other empty texts; a NULL part is the
empty string; a row without an id equals no other row's smaller id, is not labelled and so
fails the duplicate filter never; repeated rows with the smallest id of a text all pass it;
several labels of an id count if any of them says so; very long texts are judged whole, one
at a time; other columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsurvey.llm.blocks import deleted, stored

SPACE = r"[\x20\x09-\x0D]+"
CELL = "part string, mask int, n long, good long, toxic long"
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)

#: Failure of a text, from its column and the column of its words.
Filters = Mapping[str, Callable[[Column, Column], Column]]

#: Failure conditions of the first four filters.
FILTERS: Filters = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.char_length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
DUPLICATE = "E"


def judged(docs: DataFrame, filters: Filters, key: str, text: str, part: str) -> DataFrame:
    """``id, part, print, mask`` of each row; bit i of the mask is the i-th filter."""
    # Words are a column of their own, so that they are split once.
    split = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    mask = F.lit(0)
    for bit, fails in enumerate(filters.values()):
        mask += F.when(fails(F.col("text"), F.col("words")), 1 << bit).otherwise(0)
    return split.select("id", "part", F.unhex(F.sha2("text", 256)).alias("print"), mask.alias("mask"))


def cells(rows: DataFrame, marks: DataFrame, duplicate: int) -> DataFrame:
    """CELL counts of judged rows; ``duplicate`` is the bit set where a smaller id has the same text."""
    named = rows.filter("id IS NOT NULL")
    alike = named.groupBy("id", "part", "print", "mask").agg(F.count("*").alias("n"))
    first = named.groupBy("print").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    labelled = alike.join(marks, "id", "left").join(first, ["id", "print"], "left")
    mask = F.col("mask") + F.when(F.col("first"), 0).otherwise(duplicate)
    of = lambda mark: F.when(F.col(mark), F.col("n")).otherwise(0)
    known = labelled.select("part", mask.cast("int").alias("mask"), "n", of("good").alias("good"), of("toxic").alias("toxic"))
    nameless = rows.filter("id IS NULL").selectExpr("part", "mask", "1L AS n", "0L AS good", "0L AS toxic")
    sums = [F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")]
    return known.unionByName(nameless).groupBy("part", "mask").agg(*sums)


def survivors(counts: Mapping[int, tuple[int, ...]], filters: int) -> dict[int, tuple[int, ...]]:
    """Sums of the cells that pass all filters of each subset, by a walk that toggles one filter at a time."""
    failures = dict.fromkeys(counts, 0)
    running = [sum(column) for column in zip(*counts.values())]
    active, states = 0, {0: tuple(running)}
    for step in range(1, 1 << filters):
        bit = step & -step
        active ^= bit
        change = 1 if active & bit else -1
        for mask, cell in counts.items():
            if mask & bit:
                failures[mask] += change
                # Out with its first active failure, in again with the last one that goes.
                if failures[mask] == (change > 0):
                    running = [r - change * n for r, n in zip(running, cell)]
        states[active] = tuple(running)
    return states


def orders(counts: Mapping[int, tuple[int, ...]], letters: str) -> list[tuple]:
    """Rows of AUDIT without their part, from counts ``(n, good, toxic)`` by mask."""
    n = len(letters)
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    states = survivors(counts, n)
    failing = {x: sum(c[0] for m, c in counts.items() if m & bit[x]) for x in letters}
    shapley = {
        x: sum(
            factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * (states[s][0] - states[s | bit[x]][0])
            for s in states if not s & bit[x]
        )
        for x in letters
    }
    rows = []
    for order in permutations(letters):
        before = 0
        for step, x in enumerate(order, 1):
            after = before | bit[x]
            removed, good, toxic = (a - b for a, b in zip(states[before], states[after]))
            alone = counts.get(bit[x], (0,))[0]
            rows.append(("".join(order), step, states[after][0], removed, failing[x] - removed, alone, good, toxic, shapley[x]))
            before = after
    return rows


def audit(
    docs: DataFrame, labels: DataFrame, filters: Filters = FILTERS, duplicate: str = DUPLICATE,
    key: str = "doc_id", text: str = "text", part: str = "source",
) -> DataFrame:
    """AUDIT rows for each part, each order of all filters and each step.

    ``labels`` has ``key``, ``quality`` and ``toxic``, of which 1 counts. ``duplicate`` names the
    filter of repeated texts, which comes last among the letters.
    """
    letters = "".join(filters) + duplicate
    rows = stored(judged(docs, filters, key, text, part), "audit-rows")
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.groupBy(F.col(key).alias("id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    counted = stored(cells(rows, marks, 1 << len(filters)), "audit-cells")
    deleted(docs.sparkSession, rows)
    names = AUDIT.replace(" string", "").replace(" int", "").replace(" long", "").split(", ")

    def walk(group: pa.Table) -> pa.Table:
        held = group.to_pydict()
        counts = {m: c for m, *c in zip(held["mask"], held["n"], held["good"], held["toxic"])}
        columns = [*zip(*[(held["part"][0], *row) for row in orders(counts, letters)])]
        arrays = {name: pa.array(column) for name, column in zip(names, columns)}
        return pa.table(arrays | {"step": arrays["step"].cast(pa.int32())})

    return counted.groupBy("part").applyInArrow(walk, AUDIT)
