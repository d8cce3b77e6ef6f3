"""Quality of texts: random-indexing word vectors, pooled, and a small calibrated network.

Every token (a run of letters, of digits or of other signs, in its case) has a fixed
sparse index vector: +1 and -1 at two places given by its hash. The vector of a token
is the sum of the index vectors of its neighbours over the whole corpus, so that rare
tokens look like the company they keep. Tokens are held in a fixed number of hashed
cells: the table of vectors has the same size for any corpus and is summed from all
texts. A text is the mean and the spread of its token vectors, frequent tokens weighing
less, and its length. A network with one hidden layer is fitted on all labelled texts, and its
temperature on a fifth of them that the weights have not seen. Up to ``MAX_TRAIN`` of them
are fitted on the driver with numpy; more are dealt out once, by hash, in shards of about that many rows, every shard
goes on from the mean of all shards' weights for some epochs, and so on for ``TURNS`` turns.

Defined results: NULL and empty texts are scored as texts without tokens; repeated rows
get equal scores; of several labels of a document the mean decides, a tie is label 1;
labels other than 0 and 1 are left out; without labels of both kinds the score is the
share of label 1, or 0.5; other columns pass through, those named like an output are
replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsurvey.llm.arrow import Tokens, hash_values, map_arrow, mixed, replaced, slices, with_fields
from fieldsurvey.llm.blocks import deleted, stored
from fieldsurvey.llm.sums import SCHEMA, emitted, summed, whole
from fieldsurvey.skew import BROADCAST_KEYS

#: Cells and length of the vectors: the table has CELLS x DIMS numbers, 3 MB.
CELLS, DIMS = 1 << 14, 48
#: Neighbours on either side.
REACH = 2
#: Text looked at in one go; the work space of a task is some dozen times that.
PART_BYTES = 1 << 20
#: Labelled texts fitted in one place, at most about.
MAX_TRAIN = 20_000
EPOCHS, TURNS = 40, 8
#: Temperatures that are tried.
GRID = np.geomspace(0.25, 8, 60)
HIDDEN = 24
PASS_TOKENS = 1 << 16
FEATURES = 2 * DIMS + 1
#: Weights of the network and, at their end, the number of rows.
WEIGHTS = FEATURES * HIDDEN + 2 * HIDDEN + 2
#: One row a shard for the rows that are used and one for those held back; features and labels as bytes.
SHARDS = "shard long, held boolean, x binary, y binary"


def token_classes() -> np.ndarray:
    """Letters (and all bytes beyond ASCII), digits, other signs; white space is between tokens."""
    table = np.full(256, 3, np.uint8)
    table[list(b"\x20\x09\x0a\x0b\x0c\x0d\x00")] = 0
    table[48:58] = 2
    table[65:91] = table[97:123] = 1
    table[128:] = 1
    return table


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each hash, and the places of +1 and -1 in its index vector."""
    h = mixed(values)
    plus = (h >> np.uint64(20)) % np.uint64(DIMS)
    minus = (plus + np.uint64(1) + (h >> np.uint64(40)) % np.uint64(DIMS - 1)) % np.uint64(DIMS)
    return (h % np.uint64(CELLS)).astype(np.int64), plus.astype(np.int64), minus.astype(np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all cells, and their weights, from all texts of ``docs``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, counts = np.zeros(CELLS * DIMS), np.zeros(CELLS)
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                tokens = Tokens(part.column(text), token_classes(), lower=False)
                cell, plus, minus = (p[tokens.code] for p in _places(hash_values(tokens.values)))
                counts += np.bincount(cell, minlength=CELLS)
                for near in range(1, REACH + 1):
                    for low in range(0, len(cell) - near, 1 << 20):
                        a = np.arange(low, min(low + (1 << 20), len(cell) - near))
                        a = a[tokens.row[a] == tokens.row[a + near]]
                        for here, there in ((a, a + near), (a + near, a)):
                            base = cell[here] * DIMS
                            vectors += np.bincount(base + plus[there], minlength=CELLS * DIMS)
                            vectors -= np.bincount(base + minus[there], minlength=CELLS * DIMS)
        yield from emitted({"vectors": vectors, "counts": counts})

    total = summed(map_arrow(docs.select(text), task, SCHEMA))
    vectors = whole(total.get("vectors"), CELLS * DIMS).reshape(CELLS, DIMS)
    counts = whole(total.get("counts"), CELLS)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    share = counts / max(1.0, counts.sum())
    return (vectors / np.maximum(length, 1e-9)).astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """FEATURES numbers for each text."""
    tokens = Tokens(column, token_classes(), lower=False)
    n = tokens.rows
    cells = _places(hash_values(tokens.values))[0]
    total, square, mass = np.zeros((n, DIMS)), np.zeros((n, DIMS)), np.zeros(n)
    for low in range(0, len(tokens.code), PASS_TOKENS):
        row = tokens.row[low : low + PASS_TOKENS]
        cell = cells[tokens.code[low : low + PASS_TOKENS]]
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        weight = weights[cell][:, None]
        value = vectors[cell]
        total[row[begin]] += np.add.reduceat(value * weight, begin)
        square[row[begin]] += np.add.reduceat(value * value * weight, begin)
        mass[row[begin]] += np.add.reduceat(weight[:, 0], begin)
    mass = np.maximum(mass, 1e-9)[:, None]
    mean = total / mass
    spread = np.sqrt(np.maximum(square / mass - mean * mean, 0))
    size = np.log1p(np.diff(tokens.first))[:, None]
    return np.hstack([mean, spread, size])


@dataclass
class Network:
    """Standardised features, a tanh layer, a logistic output with a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float
    constant: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.tanh(z @ self.first + self.first_bias) @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -40, 40)))


def constant_network(score: float) -> Network:
    zeros = np.zeros(FEATURES)
    return Network(zeros, zeros + 1, np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0, score)


def new_network(centre: np.ndarray, scale: np.ndarray, rng: np.random.Generator) -> Network:
    return Network(centre, scale, rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, 1.0)


def losses(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Loss of each row at each temperature of GRID."""
    return np.array([np.logaddexp(0, np.where(y > 0, -margin, margin) / t) for t in GRID])


def fit(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Network by Adam on four fifths of the rows, temperature by likelihood on the rest."""
    if len(y) < 10 or y.min() == y.max():
        return constant_network(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    model = new_network(x[used].mean(0), x[used].std(0) + 1e-6, rng)
    learn(model, x, y, used, epochs, rng)
    model.temperature = float(GRID[int(np.argmin(losses(model.margin(x[held]), y[held]).mean(1)))])
    return model


def learn(model: Network, x: np.ndarray, y: np.ndarray, used: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Turns the weights of ``model`` by Adam on the rows ``used``."""
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    weights = [model.first, model.first_bias, model.second, np.full(1, model.second_bias)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(used)
        for low in range(0, len(shuffled), 256):
            rows = shuffled[low : low + 256]
            hidden = np.tanh(z[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - hidden * hidden)
            slopes = [z[rows].T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ error + 1e-4 * weights[2], error.sum(keepdims=True)]
            step += 1
            for w, g, (m, v) in zip(weights, slopes, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.second_bias = float(weights[3][0])


def _rows(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels, in an order that does not depend on the one in which rows arrive."""
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    y = np.array(batch.column("y").to_pylist(), np.float64)
    order = np.lexsort((y, *x.T[::-1]))
    return x[order], y[order]


def _packed(group: pa.Table) -> pa.Table:
    """One row for the rows of a shard that are used, or held back."""
    x, y = _rows(group)
    first = {c: group.column(c)[:1] for c in ("shard", "held")}
    return pa.table(first | {"x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """SHARDS of ``rows`` (y, x, mark): each row travels once and is read where it lies by every turn."""
    mark = lambda name, parts: F.pmod(F.xxhash64(F.lit(name), "mark"), F.lit(parts))
    dealt = rows.withColumns({"shard": mark("shard", max(1, shards)), "held": mark("held", 5) == 0})
    # The number is given, so that small shards are not put together in one task.
    return dealt.repartition(2 * max(1, shards), "shard").groupBy("shard", "held").applyInArrow(_packed, SHARDS)


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for x, y in zip(batch.column("x"), batch.column("y")):
            yield np.frombuffer(x.as_buffer(), np.float32).reshape(-1, FEATURES).astype(np.float64), np.frombuffer(y.as_buffer(), np.float64)


def _turn(state: dict, seed: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sum of the weights that each shard makes of ``state``, times its rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WEIGHTS)
        for x, y in _shard_rows(batches):
            own = Network(**{k: v.copy() if isinstance(v, np.ndarray) else v for k, v in state.items()})
            learn(own, x, y, np.arange(len(y)), EPOCHS // TURNS, np.random.default_rng([*seed, len(y)]))
            total += len(y) * np.concatenate([own.first.ravel(), own.first_bias, own.second, [own.second_bias, 1.0]])
        yield from emitted({"weights": total})

    return task


def fit_shards(rows: DataFrame, shards: int, seed: int = 7) -> Network:
    """Network by Adam on four fifths of all ``rows`` (y, x, mark), dealt out over shards; temperature on the rest."""
    table = stored(by_shard(rows, shards), "quality-shards")
    used, held = (table.filter(c).select("x", "y") for c in ("NOT held", "held"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * FEATURES + 2)
        for x, y in _shard_rows(batches):
            total += np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)])
        yield from emitted({"sums": total})

    total = whole(summed(map_arrow(used, moments, SCHEMA)).get("sums"), 2 * FEATURES + 2)
    n, ones, mean = total[0], total[1], total[2 : FEATURES + 2] / max(1.0, total[0])
    if not 0 < ones < n:
        deleted(rows.sparkSession, table)
        return constant_network(float(ones / n) if n else 0.5)
    scale = np.sqrt(np.maximum(total[FEATURES + 2 :] / n - mean * mean, 0)) + 1e-6
    model = new_network(mean, scale, np.random.default_rng(seed))
    for turn in range(TURNS):
        mean_weights = whole(summed(map_arrow(used, _turn(vars(model).copy(), [seed, turn]), SCHEMA)).get("weights"), WEIGHTS)
        mean_weights /= mean_weights[-1]
        first, bias, second = np.split(mean_weights[:-2], [FEATURES * HIDDEN, FEATURES * HIDDEN + HIDDEN])
        model.first, model.first_bias, model.second, model.second_bias = first.reshape(FEATURES, HIDDEN), bias, second, float(mean_weights[-2])
    final = vars(model).copy()

    def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(GRID))
        for x, y in _shard_rows(batches):
            total += losses(Network(**final).margin(x), y).sum(1)
        yield from emitted({"loss": total})

    model.temperature = float(GRID[int(np.argmin(whole(summed(map_arrow(held, loss, SCHEMA)).get("loss"), len(GRID))))])
    deleted(rows.sparkSession, table)
    return model


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, weights: np.ndarray, text: str = "text", key: str = "doc_id", label: str = "quality") -> Network:
    """Network fitted on all labelled texts of ``docs``."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    rows = known.count()
    # Rows of two numbers are sent to every task, if they are few.
    chosen = docs.select(key, text).join(F.broadcast(known) if rows <= BROADCAST_KEYS else known, key)
    # Copies of a text have ids of their own, so that no shard gets them all.
    chosen = chosen.withColumn("_mark", F.xxhash64(F.col(key), F.col(text)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                x = pooled(part.column(text), vectors, weights).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("_label"), pa.array([r.tobytes() for r in x], pa.binary()), part.column("_mark")], ["y", "x", "mark"])

    made = map_arrow(chosen, task, "y int, x binary, mark long")
    if rows > MAX_TRAIN:
        # Several rows may share an id that has a label.
        return fit_shards(made, -(-chosen.count() // MAX_TRAIN))
    found = made.collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in found], np.float64).reshape(len(found), FEATURES)
    # The order in which rows arrive must not matter.
    order = np.lexsort(x.T[::-1]) if len(found) else np.zeros(0, int)
    return fit(x[order], np.array([r.y for r in found], np.float64)[order])


def score(docs: DataFrame, network: Network, vectors: np.ndarray, weights: np.ndarray, text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the probability of label 1 as ``out``; the text only with ``keep_text``."""
    drop = () if keep_text else (text,)
    shared = docs.sparkSession.sparkContext.broadcast((vars(network), vectors, weights))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, v, w = shared.value
        model = Network(**parts)
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                yield replaced(part, {out: pa.array(model.scores(pooled(part.column(text), v, w)))}, drop)

    return map_arrow(docs, task, with_fields(docs, [T.StructField(out, T.DoubleType())], drop))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", out: str = "score", keep_text: bool = False) -> DataFrame:
    """Scores of all ``docs`` from vectors of all texts and a network fitted on ``labels``."""
    vectors, weights = word_vectors(docs, text)
    network = train(docs, labels, vectors, weights, text, key, label)
    return score(docs, network, vectors, weights, text, out, keep_text)
