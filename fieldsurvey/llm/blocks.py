"""Corpus counts of hashed items, brought back to the texts that hold them.

Counting n-grams or shingles row by row would shuffle many times the input. Here texts
are packed into blocks of some megabytes, written once. A block sends the sorted
distinct hashes of its items, with their counts, to ranges of the hash space, as one
row for each range; a range adds up what all blocks sent and answers every block with
the totals, in the order in which the block sent the hashes, so that they need not
travel again. What a hot item or a group of copies adds to a range is one entry for each
block. The number of ranges follows the input, so that a range fits in a task.

Blocks are tables in the shared folder: all later steps read the same blocks, whatever
tasks are repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsurvey.llm.arrow import give_back, map_arrow, slices
from fieldsurvey.scratch import new_table_path

#: Text of a block, and text for each range.
BLOCK_BYTES, RANGE_BYTES = 3 << 20, 12 << 20
LEAST_RANGES = 32
PACKED = "block long, role int, bytes long, rows binary"
SENT = "kind int, range int, block long, role int, hashes binary, counts binary"
ANSWER = "block long, kind int, range int, totals binary, distinct long, mass0 long, mass1 long"

#: Sorted distinct hashes and their counts, for each kind of item.
Items = dict[int, tuple[np.ndarray, np.ndarray]]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables made by :func:`stored` that nothing reads any more."""
    for table in tables:
        for place in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed_array(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes; the bytes of equal weight stand together."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unpacked_array(data: bytes) -> np.ndarray:
    used = data[0]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(used, -1)
    planes = np.zeros((flat.shape[1], 8), np.uint8)
    planes[:, :used] = flat.T
    return planes.view(np.uint64)[:, 0]


def packed_sorted(values: np.ndarray) -> bytes:
    return packed_array(np.diff(values, prepend=np.zeros(1, values.dtype)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked_array(data), dtype=np.uint64)


def packed_rows(batch: pa.RecordBatch | pa.Table, level: int | None = None) -> bytes:
    """``batch`` as compressed bytes, smaller and slower with a higher ``level``."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def unpacked_rows(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def pack(df: DataFrame, text: str, role: str, level: int | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``df`` in blocks of about ``size`` bytes and one ``role`` (0, 1 or 2) each; not written yet."""
    limit = size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_id, serial = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list[pa.RecordBatch], int]] = {}

        def block(number: int) -> pa.RecordBatch:
            nonlocal serial
            rows, size = held.pop(number)
            data = packed_rows(pa.Table.from_batches(rows).combine_chunks(), level)
            serial += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(task_id << 32) + serial]), pa.array([number], pa.int32()), pa.array([size]), pa.array([data])],
                ["block", "role", "bytes", "rows"],
            )

        for batch in batches:
            roles = batch.column(role).to_numpy(zero_copy_only=False)
            for number in np.unique(roles).tolist():
                for part in slices(batch.filter(pa.array(roles == number)), text, limit // 2):
                    rows, size = held.get(number, ([], 0))
                    # A copy, so that the whole batch need not stay in memory.
                    held[number] = ([*rows, part.take(pa.array(np.arange(part.num_rows)))], size + part.column(text).nbytes)
                    if held[number][1] >= limit:
                        yield block(number)
        for number in list(held):
            yield block(number)

    return map_arrow(df, task, PACKED)


def ranges_for(blocks: DataFrame) -> int:
    """Number of hash ranges for the text in ``blocks``."""
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    return max(LEAST_RANGES, -(-size // RANGE_BYTES))


def cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins in sorted hashes, and their end."""
    number = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(number, np.arange(ranges + 1, dtype=np.uint64))


def totals(blocks: DataFrame, items: Callable[[pa.RecordBatch], Items], ranges: int, counted: bool = True) -> DataFrame:
    """Answers of all ranges (ANSWER).

    ``totals`` holds for each hash that the block sent the counts of blocks of role 0,
    then those of role 1; blocks of another role are answered but do not count. Rows
    with block -1 have the number of distinct counted hashes of the range and the sums of
    the counts of either role. ``counted=False`` answers with whole counts of roles 0 and 1 only.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, role, rows in zip(*(batch.column(c).to_pylist() for c in ("block", "role", "rows"))):
                for kind, (hashes, counts) in items(unpacked_rows(rows)).items():
                    at = cuts(hashes, ranges)
                    full = np.flatnonzero(at[1:] > at[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(full), kind, np.int32)), pa.array(full.astype(np.int32)),
                            pa.array(np.full(len(full), block)), pa.array(np.full(len(full), role, np.int32)),
                            pa.array([packed_sorted(hashes[at[r] : at[r + 1]]) for r in full], pa.binary()),
                            pa.array([packed_array(counts[at[r] : at[r + 1]]) for r in full], pa.binary()),
                        ],
                        ["kind", "range", "block", "role", "hashes", "counts"],
                    )

    def add(group: pa.Table) -> pa.Table:
        give_back()
        kind, number = group.column("kind")[0].as_py(), group.column("range")[0].as_py()
        blocks_, roles = group.column("block").to_pylist(), np.array(group.column("role").to_pylist())
        hashes = [unpacked_sorted(h.as_py()) for h in group.column("hashes")]
        size = np.array([len(h) for h in hashes])
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.concatenate([unpacked_array(c.as_py()) for c in group.column("counts")]).astype(np.int64)
        of_role = np.repeat(roles, size)
        sums = []
        for role in (0, 1):
            mine = of_role == role
            sums.append(np.bincount(place[mine], counts[mine], len(distinct)).astype(np.int64))
        ends = np.cumsum(size)
        whole = sums[0] + sums[1]
        answers = []
        for low, high in zip(ends - size, ends):
            own = place[low:high]
            answers.append(packed_array(np.concatenate([sums[0][own], sums[1][own]]) if counted else np.minimum(whole[own], 2)))
        n = len(answers)
        return pa.table({
            "block": pa.array([*blocks_, -1]), "kind": pa.array([kind] * (n + 1), pa.int32()), "range": pa.array([number] * (n + 1), pa.int32()),
            "totals": pa.array([*answers, b""], pa.binary()),
            "distinct": pa.array([0] * n + [int((whole > 0).sum())]),
            "mass0": pa.array([0] * n + [int(sums[0].sum())]), "mass1": pa.array([0] * n + [int(sums[1].sum())]),
        })

    return map_arrow(blocks.select("block", "role", "rows"), send, SENT).groupBy("kind", "range").applyInArrow(add, ANSWER)


def with_totals(blocks: DataFrame, answers: DataFrame, task: Callable[[pa.RecordBatch, dict[int, np.ndarray]], pa.Table], schema) -> DataFrame:
    """``task`` on the rows of each block and the totals of its items by kind, in sorted order of their hashes."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for kind, number, data in zip(*(right.column(c).to_pylist() for c in ("kind", "range", "totals"))):
            found.setdefault(kind, []).append((number, unpacked_array(data)))
        ordered = {k: [a for _, a in sorted(v, key=lambda x: x[0])] for k, v in found.items()}
        give_back()
        return task(unpacked_rows(left.column("rows")[0].as_py()), ordered)

    kept = answers.filter("block >= 0").select("block", "kind", "range", "totals")
    return blocks.select("block", "rows").groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(meet, schema)


def joined(parts: list[np.ndarray], roles: int = 2) -> list[np.ndarray]:
    """Totals of each role over all ranges."""
    return [np.concatenate([p.reshape(roles, -1)[r] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for r in range(roles)]
