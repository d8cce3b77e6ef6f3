"""Full outer merging of several sources on a shared key.

Four exact forms give the same rows:

* ``unique=True`` for sources with one row per key: one union and one
  aggregation, hence one shuffle for any number of sources.
* a full outer join of two sources, when no key is heavy.
* for more sources a spine: the distinct keys of all of them, placed by hash once. Each
  source is joined to it from the left, which leaves the rows merged so far where
  they are, so every source is shuffled once whatever their number. A chain of
  full outer joins would shuffle all rows merged so far again for each source.
* heavy keys apart from these, in joins salted on both sides. A full outer
  join cannot be split by the engine itself, so one heavy key would end in one
  task.

Heavy keys are searched without a shuffle of all keys. Rows are counted by source in
buckets of the hash of their key, a summary that tasks make by themselves and that is
merged by adding up. A bucket has at least the rows of each of its keys, so a key can be heavy
only in a bucket that is heavy; only the keys of such buckets are counted exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsurvey.scratch import shared_folder
from fieldsurvey.skew import (
    BROADCAST_KEYS,
    HEAVY_ROWS,
    fits_broadcast,
    fixed,
    looked_at,
    rows_in,
    rows_not_in,
    same_key,
    search_fraction,
)

SALT, KEY, BUCKET = "_salt", "_key", "_bucket"
#: Buckets of the search: tried first, at most, and for each heavy key that there is room for.
FIRST_BUCKETS, MOST_BUCKETS, BUCKETS_PER_KEY = 1 << 20, 1 << 26, 8


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself; raises ValueError if a key occurs more than once."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"repeated keys in {list(keys)}")
    return df


def full_merge(
    a: DataFrame,
    b: DataFrame,
    on: str | Sequence[str],
    null_safe: bool = False,
    unique: bool = False,
    max_rows: int | None = HEAVY_ROWS,
    searched: Sequence[int] | None = None,
) -> DataFrame:
    """Full outer join of two frames with one coalesced key."""
    return merge_all([a, b], on, null_safe, unique, max_rows, searched)


def merge_all(
    dfs: Sequence[DataFrame],
    on: str | Sequence[str],
    null_safe: bool = False,
    unique: bool = False,
    max_rows: int | None = HEAVY_ROWS,
    searched: Sequence[int] | None = None,
    broadcast_bytes: int | None = None,
    spine: bool | None = None,
) -> DataFrame:
    """Full outer join of all frames; repeated keys multiply as in SQL.

    More than two frames are merged along a spine of their keys, for which their keys are read
    apart from their rows. ``spine=False`` joins them one after the other instead, for frames whose keys
    are expensive to compute; name the largest frame last then. With
    ``broadcast_bytes`` the others are merged and kept first; if they have no more bytes
    than that, they are sent to all tasks and the rows of the last frame stay where they are.
    ``null_safe`` lets missing keys match each other. ``unique`` states that no
    frame repeats a key; the plan verifies it and fails otherwise. ``max_rows``
    is the size from which a key is heavy; None skips the search. ``searched``
    numbers the frames to search, by default all: leave out those with few rows
    per key, above all if their keys are expensive to compute. If more than one
    searched frame can repeat keys, all rows are looked at: a key of moderate size in each
    of them may still have a huge product, which a sample would not show.
    """
    on = [on] if isinstance(on, str) else list(on)
    names = [c for df in dfs for c in df.columns if c not in on]
    if len(names) != len(set(names)):
        raise ValueError("sources share column names besides the key")
    columns = [*on, *names]
    if unique:
        return _merge_unique(dfs, on, null_safe).select(*columns)
    if broadcast_bytes is not None and len(dfs) > 1:
        last = len(dfs) - 1
        own = None if searched is None else [i for i in searched if i < last]
        # Others that may be broadcast are few rows, so their keys are not read apart.
        others = fixed(merge_all(dfs[:-1], on, null_safe, max_rows=max_rows, searched=own, spine=bool(spine)))
        if fits_broadcast(others, broadcast_bytes):
            return _onto_last(others, dfs[-1], on, null_safe).select(*columns)
        searched = None if searched is None else [0] * bool(own) + [1] * (last in searched)
        dfs = [others, dfs[-1]]
    heavy = None if max_rows is None else _heavy_keys(dfs, on, max_rows, searched)
    spine = len(dfs) > 2 if spine is None else spine and len(dfs) > 1
    merged = (lambda frames: _along_spine(frames, on, null_safe)) if spine else (lambda frames: reduce(lambda a, b: _outer(a, b, on, null_safe), frames))
    if heavy is None:
        return merged(dfs).select(*columns)
    parts = []
    if not null_safe:
        parts += [df.filter(~_complete(on)) for df in dfs]
        dfs = [df.filter(_complete(on)) for df in dfs]
        heavy = heavy.filter(_complete(on))
    parts.append(merged([rows_not_in(df, heavy, on) for df in dfs]))
    parts.append(_merge_heavy(dfs, on, heavy, max_rows))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*columns)


def _complete(on: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])


def _outer(a: DataFrame, b: DataFrame, on: list[str], null_safe: bool) -> DataFrame:
    if not null_safe:
        return a.join(b, on, "outer")
    right = b.withColumnsRenamed({k: f"_right_{k}" for k in on})
    joined = a.join(right, same_key(a, right, on, "_right_"), "outer")
    keys = {k: F.coalesce(F.col(k), F.col(f"_right_{k}")) for k in on}
    return joined.withColumns(keys).drop(*[f"_right_{k}" for k in on])


def _along_spine(dfs: Sequence[DataFrame], on: list[str], null_safe: bool) -> DataFrame:
    """Each frame joined from the left to the distinct keys of all, which are shuffled once."""
    whole = dfs if null_safe else [df.filter(_complete(on)) for df in dfs]
    # As a structure a key with missing parts equals itself, and the joins need no other placement than the keys have.
    key = F.struct(*on) if null_safe or len(on) > 1 else F.col(on[0])
    keyed = [df.withColumn(KEY, key) for df in whole]
    merged = reduce(DataFrame.unionAll, [df.select(KEY) for df in keyed]).distinct()
    for df in keyed:
        merged = merged.join(df.drop(*on), KEY, "left")
    parts = F.col(KEY).getField if null_safe or len(on) > 1 else lambda _: F.col(KEY)
    merged = merged.withColumns({k: parts(k) for k in on}).drop(KEY)
    # Rows without a whole key match nothing.
    apart = [] if null_safe else [df.filter(~_complete(on)) for df in dfs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [merged, *apart])


def _onto_last(others: DataFrame, last: DataFrame, on: list[str], null_safe: bool) -> DataFrame:
    """Full outer join in which only the distinct keys of ``last`` are shuffled."""
    small = others.withColumnsRenamed({k: f"_small_{k}" for k in on})

    def match(df: DataFrame) -> Column:
        if null_safe:
            return same_key(df, small, on, "_small_")
        return reduce(lambda a, b: a & b, [df[k] == small[f"_small_{k}"] for k in on])

    kept = last.join(F.broadcast(small), match(last), "left").drop(*[f"_small_{k}" for k in on])
    keys = last.select(*on).distinct()
    alone = small.join(keys, match(keys), "left_anti").withColumnsRenamed({f"_small_{k}": k for k in on})
    return kept.unionByName(alone, allowMissingColumns=True)


def _merge_unique(dfs: Sequence[DataFrame], on: list[str], null_safe: bool) -> DataFrame:
    tagged = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(dfs)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    # Without null_safe a missing key matches nothing, not even in its own source.
    apart = F.lit(None).cast("bigint") if null_safe else F.when(~_complete(on), F.monotonically_increasing_id())
    values = [c for c in rows.columns if c not in (*on, "_source")]
    counts = [F.count_if(F.col("_source") == i) for i in range(len(dfs))]
    once = reduce(lambda a, b: a & b, [n <= 1 for n in counts])
    merged = (
        rows.withColumn("_apart", apart)
        .groupBy(*on, "_apart")
        .agg(*[F.max(c).alias(c) for c in values], once.alias("_once"))
    )
    return merged.filter(F.assert_true("_once", "a source repeats a key").isNull())


def _counts(keys: Mapping[int, DataFrame], on: list[str], sources: Sequence[int]) -> DataFrame:
    """Rows per key in each source, as ``_n0``, ``_n1`` and so on."""
    tagged = [df.select(*on, F.lit(i).alias("_source")) for i, df in keys.items()]
    per_source = [F.count_if(F.col("_source") == i).alias(f"_n{i}") for i in sources]
    return reduce(DataFrame.unionAll, tagged).groupBy(*on).agg(*per_source)


def _heavy_keys(
    dfs: Sequence[DataFrame], on: list[str], max_rows: int, searched: Sequence[int] | None = None
) -> DataFrame | None:
    """Keys with many rows in a source or in the merged result, with all counts."""
    sources = range(len(dfs))
    shared_folder(dfs[0].sparkSession)
    keys = {i: df.select(*on) for i, df in enumerate(dfs)}
    wanted = list(sources if searched is None else searched)
    if not wanted:
        return None
    # A product of moderate sizes escapes a sample, so only a single source is sampled.
    found = _in_heavy_buckets(keys, on, max_rows) if len(wanted) > 1 else _in_sample(keys, wanted, on, max_rows)
    if found is None:
        return None
    heavy = fixed(_counts(found, on, sources).filter(_multiplicity(sources) > max_rows))
    return None if heavy.isEmpty() else heavy


def _in_sample(keys: Mapping[int, DataFrame], wanted: Sequence[int], on: list[str], max_rows: int) -> dict[int, DataFrame] | None:
    """Keys of all sources that are frequent in a sample of the one that is searched."""
    sources = range(len(keys))
    met = _counts({i: looked_at(keys[i], max_rows) for i in wanted}, on, sources)
    scale = 1 / search_fraction(max_rows)
    candidates = met.filter(_multiplicity(sources, scale) > max_rows / 2).select(*on)
    if candidates.isEmpty():
        return None
    candidates = fixed(candidates)
    return {i: rows_in(df, candidates, on) for i, df in keys.items()}


def _in_heavy_buckets(keys: Mapping[int, DataFrame], on: list[str], max_rows: int) -> dict[int, DataFrame] | None:
    """Keys of all sources in the buckets that are heavy; no other key can be.

    More buckets are made if the rows turn out to be too many for those tried first.
    """
    # With fewer rows than this in every source no key is heavy.
    each = max(1.0, max_rows ** (1 / len(keys)))
    buckets, wanted = 0, FIRST_BUCKETS
    while buckets < wanted:
        buckets = wanted
        placed = {i: df.withColumn(BUCKET, F.pmod(F.xxhash64(*on), F.lit(buckets))) for i, df in keys.items()}
        counts = fixed(_counts({i: df.select(BUCKET) for i, df in placed.items()}, [BUCKET], [*keys]))
        heavy = counts.filter(_multiplicity([*keys]) > max_rows).select(BUCKET)
        if heavy.isEmpty():
            return None
        rows = counts.agg(F.sum(reduce(lambda a, b: a + b, [F.col(f"_n{i}") for i in keys]))).first()[0]
        wanted = min(MOST_BUCKETS, int(BUCKETS_PER_KEY * rows / each))
    return {i: rows_in(df, heavy, [BUCKET]).drop(BUCKET) for i, df in placed.items()}


def _multiplicity(sources: Sequence[int], scale: float = 1.0) -> Column:
    """Rows a key has after merging ``sources``; an absent source counts once."""
    sizes = [F.greatest(F.col(f"_n{i}") * F.lit(scale), F.lit(1.0)) for i in sources]
    return reduce(lambda a, b: a * b, sizes)


def _merge_heavy(dfs: Sequence[DataFrame], on: list[str], heavy: DataFrame, max_rows: int) -> DataFrame:
    """Full outer merge of the heavy keys as inner joins.

    A source that lacks a key gets one empty row for it, so nothing is lost in
    an inner join. A side with few rows is broadcast. Otherwise the longer side
    of a key is dealt out over salts and the shorter side is repeated for every
    salt.
    """
    steps = range(1, len(dfs))
    sizes = [F.count("*").alias("keys")]
    sizes += [F.sum(_multiplicity([i])).alias(f"right{i}") for i in steps]
    sizes += [F.sum(_multiplicity(range(i))).alias(f"left{i}") for i in steps]
    total = heavy.agg(*sizes).first()
    padded = []
    for i, df in enumerate(dfs):
        absent = heavy.filter(F.col(f"_n{i}") == 0).select(*on)
        padded.append(rows_in(df, heavy, on).unionByName(absent, allowMissingColumns=True))
    merged = padded[0]
    for i in steps:
        a, b, keys = merged, padded[i], list(on)
        if (total[f"right{i}"] or 0) <= BROADCAST_KEYS and fits_broadcast(b):
            b = F.broadcast(b)
        elif total[f"left{i}"] <= BROADCAST_KEYS and fits_broadcast(a):
            a = F.broadcast(a)
        else:
            a, b = _salt_both(a, b, on, heavy, i, max_rows, total["keys"] <= BROADCAST_KEYS)
            keys = [*on, SALT]
        b = b.withColumnsRenamed({k: f"_right_{k}" for k in keys})
        merged = a.join(b, same_key(a, b, keys, "_right_"), "inner").drop(SALT, *[f"_right_{k}" for k in keys])
    return merged


def _salt_both(
    a: DataFrame, b: DataFrame, on: list[str], heavy: DataFrame, i: int, max_rows: int, few: bool
) -> tuple[DataFrame, DataFrame]:
    """Both sides of step ``i`` with a salt; ``a`` holds the sources before ``i``."""
    left, right = _multiplicity(range(i)), _multiplicity([i])
    # As many salts as keep the joined rows of one salt below max_rows.
    salts = F.least(F.ceil(left * right / max_rows), F.greatest(left, right)).cast("long")
    sizes = heavy.select(*on, (left >= right).alias("_left_long"), salts.alias("_salts"))
    sizes = F.broadcast(sizes) if few else sizes
    return _salted(a, sizes, on, F.col("_left_long")), _salted(b, sizes, on, ~F.col("_left_long"))


def _salted(df: DataFrame, sizes: DataFrame, on: list[str], deal: Column) -> DataFrame:
    sizes = sizes.withColumnsRenamed({k: f"_size_{k}" for k in on})
    joined = df.join(sizes, same_key(df, sizes, on, "_size_"), "inner")
    one = F.floor(F.rand() * F.col("_salts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)
    salted = joined.withColumn(SALT, F.explode(F.when(deal, F.array(one)).otherwise(every)))
    # Dealt at random, hence written once: a task run again must not deal anew.
    return fixed(salted.select(*df.columns, SALT))
