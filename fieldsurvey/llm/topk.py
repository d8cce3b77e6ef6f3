"""Exact top-k by inner product, from sorted lists that are only read in order.

The integer vectors of a block of candidates form one list for each dimension, sorted
by component. For a query a list is read from its good end: from large components for a
positive weight, from small ones for a negative weight. After each round every
candidate has a lower bound (components not met yet count as the worst of their list)
and an upper bound (they count as the component where reading stands). Reading stops
when the candidates whose upper bound reaches the k-th best score so far are few;
their final scores are then resolved. At the end of the lists all bounds are scores.
Nothing is looked up at random while lists are read. Bounds of many queries are made at
once as matrix products.

Queries are a stated set. Queries and candidates are dealt into groups by hash, and
each pair of groups meets in one task, which passes on at most k rows for each query.
A common vector is spread by its id.

Defined results: NULL vectors and vectors with a NULL or non-finite component take no
part; repeated ids are candidates each, and none of them for a query with that id;
vectors of another length than the query's are no candidates; ties go to the smaller
id; a query with fewer than k candidates gets them all; an empty vector scores 0; a
component that does not fit 31 bits after scaling is an error; without vectors or
queries the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group of candidates, of a group of queries, and of a block of lists.
CANDIDATES, QUERIES, BLOCK = 32_768, 1_024, 4_096
#: Part of each list that has been read after each round.
ROUNDS = (1 / 16, 1 / 4, 1.0)
#: Reading goes on while more than this part of a block's scores may still qualify.
FEW = 0.02
#: Bar of a query that has fewer than k candidates so far.
LOWEST = -(2**62)
RESULT = "query_id long, vec_id long, score long"


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; NULL where a component is NULL or not finite."""
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), size)


class Lists:
    """Sorted lists of a block of candidates."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        order = np.argsort(values, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(n)[:, None], 0)
        self.sorted = np.take_along_axis(values, order, 0)

    def read(self, part: float) -> tuple[np.ndarray, ...]:
        """Components as they count in lower and upper bounds, for lists read from the top and from the bottom."""
        n = len(self.values)
        depth = max(1, int(np.ceil(n * part)))
        top, bottom = self.rank >= n - depth, self.rank < depth
        return (
            np.where(top, self.values, self.sorted[0]), np.where(top, self.values, self.sorted[n - depth]),
            np.where(bottom, self.values, self.sorted[-1]), np.where(bottom, self.values, self.sorted[depth - 1]),
        )


class Best:
    """The k best candidates so far of each query."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), LOWEST)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def bar(self) -> np.ndarray:
        """Score that a candidate must reach."""
        return self.score[:, -1]

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
        nth = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        kept = nth < self.k
        for q, low, high in zip(query[begin], begin, np.append(begin[1:], len(query))):
            rows = slice(low, low + int(kept[low:high].sum()))
            score, ident = np.append(self.score[q], scores[rows]), np.append(self.id[q], ids[rows])
            best = np.lexsort((ident, -score))[: self.k]
            self.score[q], self.id[q] = score[best], ident[best]


def search(queries: np.ndarray, query_ids: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query number, id and score of the k best candidates of each query."""
    best = Best(len(queries), k)
    size = queries.shape[1]
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(values).max(initial=0)) * max(1, size)
    # Whole numbers are exact in these types up to the bound.
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
    up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    for low in range(0, len(values), BLOCK):
        block, own = values[low : low + BLOCK], ids[low : low + BLOCK]
        lists = Lists(block.astype(kind))
        for part in ROUNDS:
            lower_up, upper_up, lower_down, upper_down = lists.read(part)
            upper = up @ upper_up.T + down @ upper_down.T
            bar = best.bar()
            if part < 1:
                # The k-th best lower bound of this block may be a better bar than what was found before.
                if len(block) > k:
                    # All rows with the query's id are removed in the end, so none of them may raise the bar.
                    lower = np.where(query_ids[:, None] == own, kind(LOWEST), up @ lower_up.T + down @ lower_down.T)
                    kth = np.partition(lower, len(block) - k, axis=1)[:, len(block) - k]
                    bar = np.maximum(bar, np.ceil(kth).astype(np.int64))
            open_ = upper >= bar[:, None]
            if part == 1 or open_.mean() <= FEW:
                break
        query, row = np.nonzero(open_)
        other = query_ids[query] != own[row]
        query, row = query[other], row[other]
        scores = np.empty(len(query), np.int64)
        for at in range(0, len(query), 1 << 16):
            q, r = query[at : at + (1 << 16)], row[at : at + (1 << 16)]
            scores[at : at + (1 << 16)] = np.einsum("ij,ij->i", queries[q], block[r])
        best.add(query, own[row], scores)
    query, nth = np.nonzero(best.id != np.iinfo(np.int64).max)
    return query, best.id[query, nth], best.score[query, nth]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for each row with ``is_query``.

    ``vector`` is an array of long.
    """
    sound = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(
        "id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)"
    ).withColumn("v", F.when(F.exists("v", lambda x: F.abs(x) >= 2**31), F.raise_error(F.lit("a component does not fit 31 bits"))).otherwise(F.col("v")))
    rows, asking = sound.agg(F.count("*"), F.count_if("asks")).first()
    n_c, n_q = max(1, -(-rows // CANDIDATES)), max(1, -(-asking // QUERIES))
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = sound.filter("asks").dropDuplicates(["id", "v"]).select("id", "v", F.size("v").alias("size"), dealt(n_q, "q").alias("q"), every(n_c).alias("c"))
    given = sound.select("id", "v", F.size("v").alias("size"), dealt(n_c, "c").alias("c"), every(n_q).alias("q"))
    part = ["size", "q", "c"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if left.num_rows and right.num_rows:
            size = left.column("size")[0].as_py()
            order = np.argsort(right.column("id").to_numpy(), kind="stable")
            query_ids, ids = left.column("id").to_numpy(), right.column("id").to_numpy()[order]
            query, ident, score = search(_matrix(left.column("v"), size), query_ids, _matrix(right.column("v"), size)[order], ids, k)
            found = (query_ids[query], ident, score)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found)})

    met = asked.groupBy(*part).cogroup(given.groupBy(*part)).applyInArrow(meet, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
