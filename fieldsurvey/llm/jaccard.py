"""Near-duplicate classes by an exact Jaccard join of word shingles.

Only sets that share most of their shingles can be alike, so the work shrinks in steps,
none of which drops a link between different texts:

1. Shingles are counted over all texts by blocks (see ``blocks``), as short hashes sized
   to the input. A set whose shared shingles are too few is alone; a false match of
   short hashes only keeps a set for the next step.
2. Equal sets are one class; only its representative goes on.
3. The representatives' shingles are counted exactly. Lists of the index hold a set
   under its rarest shared shingles, as many as a partner can't avoid. The position
   in that order bounds the overlap, and so the size of a partner: a list is kept in
   blocks by size, and blocks outside of the bound are skipped.
4. Each set is first compared with one set only, the most central of its lists (a near
   copy of many is found by its own rare shingles and by its centre's common ones).
   Links made so join most sets of a group without a pair for every two of them.
5. What may still join different components is compared: sets outside the largest
   component of a list, with the others of that list. Their overlap is first derived from
   the overlaps already computed with a common centre (at most the smaller overlap inside
   it and the smaller rest outside of it); only pairs that this bound leaves are verified.

Sets are held as 64-bit hashes of shingles.

Defined results: NULL, empty and blank texts have no shingles, no links and are their own
component; texts with fewer words than a shingle have one, the whole sequence; repeated
rows are equal sets; with a NULL id a row belongs to the component, but gives no name to
it; very long texts are one set like any other; other columns are dropped; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsurvey.llm.arrow import Tokens, chained, map_arrow, word_classes
from fieldsurvey.llm.blocks import Items, deleted, joined, pack, packed_sorted, ranges_for, stored, totals, unpacked_sorted, with_totals
from fieldsurvey.llm.graph import components
from fieldsurvey.skew import fixed

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Text of a block: its shingles take some dozen times that in a task.
SET_BYTES = 3 << 19
#: Sizes of one block of a list differ by less than this factor.
SIZE_STEP = 4 / 3


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins."""
    tokens = Tokens(column, word_classes())
    h, n = tokens.hashes(), len(tokens.code)
    count = np.diff(tokens.first)
    if n >= words:
        value = chained([h[i : n - words + 1 + i] for i in range(words)])
    else:
        value = np.zeros(0, np.uint64)
    parts = []
    for row in range(tokens.rows):
        low, high = tokens.first[row], tokens.first[row + 1]
        if count[row] >= words:
            parts.append(np.unique(value[low : high - words + 1]))
        elif count[row]:
            parts.append(chained([h[i : i + 1] for i in range(low, high)]))
        else:
            parts.append(np.zeros(0, np.uint64))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum([0, *map(len, parts)])


def least_overlap(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Smallest intersection with which sets of sizes ``a`` and ``b`` link."""
    return F.ceil(percent * (a + b) / (100 + percent) - 1e-9)


def _sets_of(blocks: DataFrame, text: str, key: str, kind: str, words: int, percent: int) -> DataFrame:
    """id (of type ``kind``), n, fp, and for the first of equal sets in a block its shingles; fp is NULL where a set is alone."""
    bytes_ = blocks.agg(F.sum("bytes")).first()[0] or 1
    # About one false match in 256 shingles.
    bits = min(64, max(24, int(np.ceil(np.log2(bytes_ / 4 + 1))) + 8))
    mask = ~np.uint64((1 << (64 - bits)) - 1)

    def items(rows: pa.RecordBatch) -> Items:
        values, _ = shingle_sets(rows.column(text), words)
        hashes, counts = np.unique(values & mask, return_counts=True)
        return {0: (hashes, counts)}

    def task(rows: pa.RecordBatch, found: dict[int, list[np.ndarray]]) -> pa.Table:
        values, begin = shingle_sets(rows.column(text), words)
        seen = np.concatenate(found[0]).astype(np.int64) if found else np.zeros(0, np.int64)
        short = values & mask
        shared = seen[np.searchsorted(np.unique(short), short)] >= 2
        n = np.diff(begin)
        many = np.add.reduceat(np.append(shared, False).astype(np.int64), begin[:-1]) if len(n) else n
        many = np.where(n > 0, many, 0)
        live = (n > 0) & (100 * many >= percent * n)
        prints: list[bytes | None] = [None] * len(n)
        sets: list[bytes | None] = [None] * len(n)
        first: set[bytes] = set()
        for row in np.flatnonzero(live):
            own = values[begin[row] : begin[row + 1]]
            prints[row] = xxhash.xxh3_128_digest(own.tobytes())
            if prints[row] not in first:
                first.add(prints[row])
                sets[row] = packed_sorted(own[shared[begin[row] : begin[row + 1]]])
        return pa.table({"id": rows.column(key), "n": pa.array(n), "fp": pa.array(prints, pa.binary()), "items": pa.array(sets, pa.binary())})

    ranges = ranges_for(blocks)
    answers = totals(blocks, items, ranges, counted=False)
    return with_totals(blocks, answers, task, f"id {kind}, n long, fp binary, items binary")


def _indexed(sets: DataFrame, percent: int) -> DataFrame:
    """Representatives that may have a partner: fp, n, s (shared shingles), central, items, lists (shingle and bound)."""
    carriers = sets.filter("items IS NOT NULL").groupBy("fp").agg(F.first("n").alias("n"), F.first("items").alias("items"))
    blocks = stored(pack(carriers.withColumn("role", F.lit(0)), "items", "role"), "jaccard-sets")

    def unpacked(rows: pa.RecordBatch) -> list[np.ndarray]:
        return [unpacked_sorted(x.as_py()) for x in rows.column("items")]

    def items(rows: pa.RecordBatch) -> Items:
        return {0: np.unique(np.concatenate(unpacked(rows)), return_counts=True)}

    def task(rows: pa.RecordBatch, found: dict[int, list[np.ndarray]]) -> pa.Table:
        own = unpacked(rows)
        distinct = np.unique(np.concatenate(own))
        count = sum(joined(found[0]))
        out: dict[str, list] = {c: [] for c in ("fp", "n", "s", "central", "items", "lists", "left")}
        for fp, n, values in zip(rows.column("fp").to_pylist(), rows.column("n").to_pylist(), own):
            df = count[np.searchsorted(distinct, values)]
            values, df = values[df >= 2], df[df >= 2]
            need = -(-percent * n // 100)
            if len(values) < need:
                continue
            order = np.lexsort((values, df))[: len(values) - need + 1]
            out["fp"].append(fp)
            out["n"].append(n)
            out["s"].append(len(values))
            out["central"].append(float(np.log2(df).sum() / n))
            out["items"].append(packed_sorted(values))
            out["lists"].append(values[order].view(np.int64))
            out["left"].append(len(values) - np.arange(len(order)))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

    answers = totals(blocks, items, ranges_for(blocks))
    schema = "fp binary, n long, s long, central double, items binary, lists array<long>, left array<long>"
    index = stored(with_totals(blocks, answers, task, schema), "jaccard-index")
    deleted(index.sparkSession, blocks)
    return index


def _size_block(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(SIZE_STEP)) + 1e-9).cast("int")


def _postings(index: DataFrame, *more: str) -> DataFrame:
    """One row for each set and list: ``left`` bounds what a partner found here can share."""
    cells = index.select("fp", "n", "s", "central", *more, F.explode(F.arrays_zip("lists", "left")).alias("cell"))
    return cells.select("fp", "n", "s", "central", *more, F.col("cell.lists").alias("w"), F.col("cell.left").alias("left"))


def overlaps(pairs: DataFrame, index: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with the number of shingles that both sets hold as ``both``."""
    left = index.select(F.col("fp").alias(a), F.col("items").alias("_ia"))
    right = index.select(F.col("fp").alias(b), F.col("items").alias("_ib"))
    met = pairs.join(left, a).join(right, b)
    schema = met.drop("_ia", "_ib").schema.add("both", "long")

    def task(batches):
        for batch in batches:
            both = []
            cache: dict[bytes, np.ndarray] = {}
            for x, y in zip(batch.column("_ia"), batch.column("_ib")):
                known = []
                for data in (x.as_py(), y.as_py()):
                    if data not in cache:
                        if len(cache) > 64:
                            cache.clear()
                        cache[data] = unpacked_sorted(data)
                    known.append(cache[data])
                small, large = sorted(known, key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both.append(int((large[at] == small).sum()) if len(large) else 0)
            kept = [n for n in batch.schema.names if n not in ("_ia", "_ib")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(both, pa.int64())], [*kept, "both"])

    return map_arrow(met, task, schema)


def links(index: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links ``a, b`` that connect all sets of ``index`` that are connected."""
    lists = _postings(index).withColumn("block", _size_block(F.col("n")))
    centre = lists.groupBy("w", "block").agg(F.max(F.struct("central", "fp", "n", "left")).alias("c"), F.count("*").alias("many"))
    centre = centre.filter("many > 1").select("w", "block", "c")
    near = (
        lists.join(centre, ["w", "block"]).filter(F.col("fp") != F.col("c.fp"))
        .filter((F.struct("central", "fp") < F.struct("c.central", "c.fp")))
        .filter(F.least("left", "c.left") >= least_overlap(F.col("n"), F.col("c.n"), percent))
    )
    first = near.groupBy("fp").agg(F.max(F.struct(F.col("c.central").alias("central"), F.col("c.fp").alias("b"), F.col("c.n").alias("nb"))).alias("c"), F.first("n").alias("na"), F.first("s").alias("sa"))
    first = first.select(F.col("fp").alias("a"), "na", "sa", F.col("c.b").alias("b"), F.col("c.nb").alias("nb"))
    compared = stored(overlaps(first, index), "jaccard-first")
    is_link = F.col("both") >= least_overlap(F.col("na"), F.col("nb"), percent)
    made = compared.filter(is_link).select("a", "b")
    comps = components(made)
    # A centre stands at its own distance: all of it lies inside.
    known = compared.select(F.col("a").alias("fp"), F.col("b").alias("hub"), F.col("both").alias("inside"))
    marked = (
        index.join(comps.withColumnRenamed("node", "fp"), "fp", "left").join(known, "fp", "left")
        .withColumns({"comp": F.coalesce("comp", "fp"), "hub": F.coalesce("hub", "fp"), "inside": F.coalesce("inside", "s")})
    )
    lists = _postings(marked, "comp", "hub", "inside").withColumn("block", _size_block(F.col("n")))
    major = lists.groupBy("w").agg(
        F.max(F.struct("central", "fp", "comp")).alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")
    ).filter("low <> high").select("w", F.col("m.comp").alias("major"))
    several = lists.join(major, "w")
    minor = several.filter("comp <> major").drop("major")
    # Blocks of sizes that the position in the list leaves possible; all others are skipped.
    largest = F.least(F.floor(100 * F.col("n") / percent), F.floor((100 + percent) * F.col("left") / percent + 1e-9) - F.col("n"))
    smallest = F.ceil(percent * F.col("n") / 100 - 1e-9)
    probes = minor.filter(smallest <= largest).select(
        *[F.col(c).alias(f"a_{c}") for c in minor.columns if c not in ("w", "block")], "w", largest.alias("most"), smallest.alias("least"),
        F.explode(F.sequence(_size_block(smallest), _size_block(largest))).alias("block"),
    )
    met = probes.join(several.drop("major"), ["w", "block"]).filter(
        (F.col("comp") != F.col("a_comp")) & F.col("n").between(F.col("least"), F.col("most"))
        & (F.least("left", "a_left") >= least_overlap(F.col("n"), F.col("a_n"), percent))
    )
    # Derived from what is known about both and a common centre.
    derived = F.least("inside", "a_inside") + F.least(F.col("s") - F.col("inside"), F.col("a_s") - F.col("a_inside"))
    open_ = met.filter((F.col("hub") != F.col("a_hub")) | (derived >= least_overlap(F.col("n"), F.col("a_n"), percent)))
    pairs = open_.select(
        F.least("fp", "a_fp").alias("a"), F.greatest("fp", "a_fp").alias("b"), (F.col("n") + F.col("a_n")).alias("sizes")
    ).distinct()
    more = overlaps(pairs, index).filter(F.col("both") >= least_overlap(F.col("sizes"), F.lit(0), percent)).select("a", "b")
    found = stored(made.unionByName(more), "jaccard-links")
    deleted(found.sparkSession, compared)
    return found


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id`` for each row of ``df``; ``key`` has any type with an order."""
    blocks = stored(pack(df.select(key, text).withColumn("__role", F.lit(0)), text, "__role", size=SET_BYTES), "jaccard-blocks")
    sets = stored(_sets_of(blocks, text, key, df.schema[key].dataType.simpleString(), words, percent), "jaccard-found")
    deleted(df.sparkSession, blocks)
    index = _indexed(sets, percent)
    found = links(index, percent)
    comps = components(found).withColumnRenamed("node", "fp")
    own = sets.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least"))
    placed = own.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    # A table of its own: the members of a large component are then shuffled for this join alone, and the engine may split them.
    named = fixed(placed.groupBy("comp").agg(F.min("least").alias("component_id")))
    of_class = placed.select("fp", "comp").join(named, "comp").select("fp", "component_id")
    grouped = sets.filter("fp IS NOT NULL").join(of_class, "fp").select("id", "n", "component_id")
    alone = sets.filter("fp IS NULL").select("id", "n", F.col("id").alias("component_id"))
    placed = grouped.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
    result = stored(placed, "jaccard-classes")
    deleted(df.sparkSession, sets, index, found)
    return result
