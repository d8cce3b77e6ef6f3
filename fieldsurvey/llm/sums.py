"""Sums of large arrays over all tasks, without a task that sees all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that travel together; a task emits one row for each chunk of its array.
CHUNK = 16_384
SCHEMA = "name string, chunk int, cells binary"


def emitted(arrays: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA for the arrays that a task has summed, without empty chunks."""
    for name, array in arrays.items():
        rows = [
            (i // CHUNK, part.astype(np.float64).tobytes())
            for i in range(0, len(array), CHUNK)
            if (part := array[i : i + CHUNK]).any()
        ]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])],
                ["name", "chunk", "cells"],
            )


def _summed(group: pa.Table) -> pa.Table:
    total = np.zeros(0)
    for cells in group.column("cells"):
        part = np.frombuffer(cells.as_py(), np.float64)
        total = total + part if len(total) else part.copy()
    return pa.table({
        "name": pa.array([group.column("name")[0].as_py()]), "chunk": pa.array([group.column("chunk")[0].as_py()], pa.int32()),
        "cells": pa.array([total.tobytes()]),
    })


def summed(parts: DataFrame) -> dict[str, dict[int, np.ndarray]]:
    """Total of each chunk of each name, on the driver.

    What arrives is as long as the arrays, whatever the number of tasks; callers bound it.
    Sums are made in two steps over groups of about the square root of the number of tasks.
    """
    tasks = parts.rdd.getNumPartitions()
    salts = max(1, int(tasks**0.5))
    salted = parts.withColumn("salt", F.spark_partition_id() % salts)
    first = salted.groupBy("name", "chunk", "salt").applyInArrow(_summed, SCHEMA)
    rows = first.groupBy("name", "chunk").applyInArrow(_summed, SCHEMA).collect()
    out: dict[str, dict[int, np.ndarray]] = {}
    for r in rows:
        out.setdefault(r.name, {})[r.chunk] = np.frombuffer(r.cells, np.float64)
    return out


def whole(chunks: dict[int, np.ndarray] | None, size: int) -> np.ndarray:
    """The array of ``size`` cells from its chunks."""
    out = np.zeros(size)
    for chunk, cells in (chunks or {}).items():
        out[chunk * CHUNK : chunk * CHUNK + len(cells)] = cells
    return out
