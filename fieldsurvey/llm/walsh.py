"""Exact nearest centroids of integer vectors by a progressive Walsh-Hadamard search.

Vectors and centroids are transformed by sums and differences only, so all coefficients are
whole numbers, and the squared distance of two transforms is the squared distance of the
vectors times their length. Coefficients are taken in order of their sign changes, coarse
to fine. After each level the leading centroid is finished, which gives a bar; a centroid
whose differences so far already exceed the bar is strictly worse and goes out. What is left
after the last level has all coefficients in its distance, hence ties are seen exactly.

Clustering repeats that search: tasks send one row of sums for each cluster, which are added
up before and after the shuffle, and the driver holds nothing but the centroids.

Defined results: vectors that are NULL, of another length or with a NULL or non-finite
component are left out; ties go to the smaller centroid; repeated rows are vectors each; a
row without an id is clustered like any other, and its id counts as no digits in the choice of
the first centroids, where equal ids go by their components; with fewer vectors than
centroids there are as many centroids as vectors; a distance or a sum of distances that does
not fit a long is an error, and so are components and their sums beyond 38 digits; other columns pass through, those named like a new column are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsurvey.llm.arrow import map_arrow, replaced, with_fields
from fieldsurvey.llm.blocks import stored

#: Rows searched at once.
SLICE = 2_048
#: Components below this size keep all squares of a transform within 64 bits for vectors of up to 64 components.
SMALL = 2**24
LARGEST = 2**63 - 1


def sound(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none NULL or non-finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit numbers where their transforms fit, else as unbounded ones."""
    down = np.floor(values.astype(np.float64) * scale)
    if not down.size or (np.abs(down).max() < SMALL and down.shape[1] <= 64):
        return down.astype(np.int64)
    return np.array([[int(x) for x in row] for row in down], dtype=object)


def fine_order(size: int) -> np.ndarray:
    """Coefficients by their number of sign changes."""
    rows = transform(np.eye(size, dtype=np.int64), np.arange(size))
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")


def transform(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row in ``order``; rows are filled up with zeros to its length."""
    size = len(order)
    out = np.zeros((len(values), size), values.dtype)
    out[:, : values.shape[1]] = values
    half = 1
    while half < size:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), size)
        half *= 2
    return out[:, order]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Centroid and squared distance of each row, and the number of coefficient differences taken.

    Both are transforms in the same order of coefficients.
    """
    n, size = vectors.shape
    k = len(centroids)
    row, col = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    seen = np.zeros(n * k, vectors.dtype)
    bar = np.full(n, -1, vectors.dtype)
    level, done, taken = 1, 0, 0
    while done < size:
        part = vectors[row, done:level] - centroids[col, done:level]
        seen = seen + (part * part).sum(1)
        taken += part.size
        if level < size:
            # Pairs of a row stand together; its leader is the first with the smallest sum.
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            low = np.repeat(np.minimum.reduceat(seen, starts), np.diff(starts, append=len(row)))
            leading = np.flatnonzero(seen == low)
            lead = leading[np.unique(row[leading], return_index=True)[1]]
            rest = vectors[row[lead], level:] - centroids[col[lead], level:]
            full = seen[lead] + (rest * rest).sum(1)
            taken += rest.size
            bar[row[lead]] = np.where(bar[row[lead]] < 0, full, np.minimum(bar[row[lead]], full))
            stay = seen <= bar[row]
            row, col, seen = row[stay], col[stay], seen[stay]
        done, level = level, min(size, level * 4)
    best = np.full(n, -1, vectors.dtype)
    winner = np.zeros(n, np.int64)
    # Smaller numbers last, so that they stay where distances are equal.
    for c in range(k - 1, -1, -1):
        at = np.flatnonzero(col == c)
        r, d = row[at], seen[at]
        better = (best[r] < 0) | (d <= best[r])
        best[r[better]], winner[r[better]] = d[better], c
    return winner, best // size, taken


def searched(batch: pa.RecordBatch, vector: str, centroids: list[list[int]], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch, their whole vectors, the nearest centroid of each and its squared distance."""
    dims = len(centroids[0])
    order = fine_order(1 << (dims - 1).bit_length())
    large = max(abs(x) for c in centroids for x in c) >= SMALL
    for at in range(0, batch.num_rows, SLICE):
        part = batch.slice(at, SLICE)
        flat = part.column(vector).flatten().to_numpy(zero_copy_only=False)
        values = whole(flat.reshape(part.num_rows, dims), scale)
        kind = object if large or values.dtype == object else np.int64
        found, distance, _ = nearest(transform(values.astype(kind), order), transform(np.array(centroids, dtype=kind), order))
        if kind is object and max(distance) > LARGEST:
            raise ArithmeticError("a squared distance does not fit a long")
        yield part, values, found, distance.astype(np.int64)


def first_centroids(kept: DataFrame, k: int, scale: int, key: str, vector: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``1:`` and their id."""
    named = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = kept.select(named.alias("hash"), F.col(vector).alias("v")).orderBy("hash", "v").limit(k).collect()
    return [whole(np.array([r.v]), scale)[0].tolist() for r in rows]


def moved(kept: DataFrame, centroids: list[list[int]], scale: int, vector: str) -> list[list[int]]:
    """Floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    dims = len(centroids[0])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), dims), dtype=object)
        count = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, values, found, _ in searched(batch, "v", centroids, scale):
                for c in np.unique(found):
                    sums[c] += values[found == c].sum(0)
                count += np.bincount(found, minlength=len(centroids))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used]), pa.array([[str(x) for x in s] for s in sums[used]], pa.list_(pa.string()))],
            ["cluster", "n", "sums"],
        )

    parts = kept.select(F.col(vector).alias("v")).mapInArrow(task, "cluster int, n long, sums array<string>")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    out = list(centroids)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
    return out


def cluster(
    df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``df`` with ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid``.

    The vector column is dropped; rows that take no part are left out.
    """
    spark = df.sparkSession
    name = f"`{vector}`"
    kept = df.filter(sound(F.col(name), dims))
    centroids = first_centroids(kept, k, scale, f"`{key}`", name)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids, scale, name)
    new = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    # Other columns that have the names of later ones go as well.
    drop = (vector, "cluster_inertia", "inertia", "centroid")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, found, distance in searched(batch, vector, centroids, scale):
                yield replaced(part, {"cluster": pa.array(found, pa.int32()), "distance": pa.array(distance)}, drop)

    assigned = stored(map_arrow(kept, task, with_fields(df, new, drop)), "clusters")
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    whole_sum = sum(sums.values())
    if whole_sum > LARGEST:
        raise ArithmeticError("the sum of squared distances does not fit a long")
    facts = spark.createDataFrame(
        [(c, sums.get(c, 0), whole_sum, [*map(Decimal, v)]) for c, v in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid array<decimal(38,0)>",
    )
    # As many rows as centroids.
    return assigned.join(F.broadcast(facts), "cluster")
