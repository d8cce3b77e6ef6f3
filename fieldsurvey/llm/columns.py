"""Column code over long arrays, and names that clash with nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; inside of lambdas nothing else is shared."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """``at`` after all of ``items`` and the rows (array of ``kind``) emitted on the way as ``out``.

    ``step`` takes the place so far (int, from 0) and an item, and gives the new place and an array of rows. Rows are
    gathered in parts of about the root of their number, so that a long list is not copied with each of its
    rows. ``items`` has at least one item.
    """

    def one(so_far: Column, item: Column) -> Column:
        at, rows = step(so_far["at"], item)
        return F.struct(at.alias("at"), F.concat(so_far["out"], rows).alias("out"))

    def along(items: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(items))).cast("int")

        def part(so_far: Column, first: Column) -> Column:
            empty = F.struct(so_far["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
            done = F.aggregate(F.slice(items, first, width), empty, one)
            return bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(so_far["out"], F.array(d["out"])).alias("out")))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        firsts = F.sequence(F.lit(1), F.size(items), width)
        return F.aggregate(firsts, begin, part, lambda x: F.struct(x["at"].alias("at"), F.flatten(x["out"]).alias("out")))

    return bound(items, along)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly that name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
