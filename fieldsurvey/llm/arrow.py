"""Text columns as flat arrays: tokens of a whole Arrow batch at once.

Tasks get Arrow batches. Splitting text row by row in Python would dominate every
operator here, so the bytes of all rows of a batch are looked at together: a table
of 256 classes says which bytes belong to a token, a token ends where the class or
the row changes. Memory is a few times the batch, never more than one batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
# Text of one slice of a batch; a longer single text is a slice of its own.
SLICE_BYTES = 8 << 20


def word_classes() -> np.ndarray:
    """1 for every byte of a word `[^\\x20\\x09-\\x0D]+`, 0 between words."""
    table = np.ones(256, np.uint8)
    table[list(SPACES)] = 0
    return table


def lower_table() -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the row offsets in them, from 0; NULL is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for row, n in enumerate(lengths):
        if row > begin and held + n > limit:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += int(n)
    yield batch.slice(begin)


class Tokens:
    """Tokens of all rows of a column: ``row``, distinct values and ``code`` of each token."""

    def __init__(self, column: pa.Array, classes: np.ndarray, lower: bool = True):
        data, offsets = text_bytes(column)
        self.rows = len(offsets) - 1
        kind = classes[data]
        if lower:
            data = lower_table()[data]
        n = len(data)
        change = np.zeros(n + 1, bool)
        if n:
            change[1:n] = kind[1:] != kind[:-1]
            change[0] = True
            change[offsets[:-1]] = True
        at = np.flatnonzero(change[:n])
        ends = np.append(at[1:], n)
        held = kind[at] != 0
        self.start, self.end = at[held], ends[held]
        self.kind = kind[self.start]
        # First token of every row, and one past the last row.
        self.first = np.append(np.searchsorted(self.start, offsets[:-1]), len(self.start))
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        self.offsets = offsets
        lengths = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=lengths[1:])
        flat = pa.Array.from_buffers(
            pa.large_binary(), len(self.start), [None, pa.py_buffer(lengths), pa.py_buffer(data[kind != 0].tobytes())]
        ).dictionary_encode()
        self.code = flat.indices.to_numpy(zero_copy_only=False)
        self.values: list[bytes] = flat.dictionary.to_pylist()

    def hashes(self) -> np.ndarray:
        """64-bit hash of every token."""
        return hash_values(self.values)[self.code]


def hash_values(values: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence from the hashes of its members; order matters."""
    total = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        total = total * np.uint64(0x9E3779B97F4A7C15) + part
    return mixed(total)


def give_back() -> None:
    """Memory that this worker has freed goes back to the machine; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    # Only the C library of Linux has this.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task``, which gives its memory back once it has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def map_arrow(
    df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """``df.mapInArrow``, which by itself fails for columns with a dot or a backtick in their name.

    Workers give the memory of their task back.
    """
    names = df.columns
    task = giving_back(task)
    if not any("." in n or "`" in n for n in names):
        return df.mapInArrow(task, schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return task(b.rename_columns(names) for b in batches)

    return df.toDF(*[f"_{i}" for i in range(len(names))]).mapInArrow(named, schema)


def with_fields(df: DataFrame, fields: list[T.StructField], drop: tuple[str, ...] = ()) -> T.StructType:
    """Schema of ``df`` without ``drop`` and without columns that ``fields`` replace, then ``fields``."""
    new = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in new and f.name not in drop] + fields)


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """``batch`` with ``columns`` at its end, in the order of :func:`with_fields`."""
    kept = [n for n in batch.schema.names if n not in columns and n not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns.values()], [*kept, *columns])
