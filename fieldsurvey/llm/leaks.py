"""Benchmark items in texts, also paraphrased ones, by latent semantic retrieval.

Texts are cut into passages of two half passages that overlap by one half. Passages and
items are TF-IDF vectors over the items' words, in a fixed number of hashed cells;
document frequencies are counted over all passages of all texts. A singular value
decomposition finds the main directions of these vectors: the main directions of the items
are multiplied by all passages of all texts and their transpose, task by task, and the
sums of the tasks give the main directions of both (Nystrom's method, one reading). Every
passage of every text is then projected and compared with every item. An item longer than a passage is compared as a whole and by windows of a
passage's length, since a passage holds only a small share of a long item, also of a word-for-word
copy. Candidates above ``cosine`` that hold a fair share of the weight of the item or window (a
passage of which only a word or two count can have a high cosine too) are checked on the words: the share of the item
in the longest common subsequence with any stretch of the text of about its length, and
the share of its answer (the last sentence, or the last quarter of its words) in that
stretch. An item leaks where its own share is high, or fair with the answer present.

The items of one round are sent to all tasks; they have about ``ROUND_ITEMS`` vectors, windows
counted, and more items take more rounds. Texts are cut into words once a round: they are written
to the shared folder with the cell of each word, from which all later steps work; only texts
with a candidate are cut again. No text is shuffled.

Defined results: NULL and empty texts and items leak nothing; an item with fewer words
than ``SHORT_ITEM`` has too few for directions and leaks where its whole word sequence stands in a
text, with cosine and shares of 1; repeated items are reported
each, repeated rows too; very long texts are cut like any other; other columns pass through, one named
like the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsurvey.llm.arrow import Tokens, map_arrow, replaced, slices, with_fields
from fieldsurvey.llm.blocks import deleted, stored
from fieldsurvey.llm.sums import SCHEMA, emitted, summed, whole

#: Words of half a passage.
HALF = 24
#: A word as :func:`term_classes` has it.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
CELLS = 1 << 14
#: A cell plus one.
CODE = np.dtype("<u2")
#: Text, words and passages that a task looks at together, which bounds its memory.
PART_BYTES, PART_WORDS, PART_PASSAGES = 1 << 20, 1 << 14, 1 << 12
RANK, EXTRA = 128, 16
#: Rows that :func:`add_rows` adds to the same row in one go.
RUN_ROWS = 64
#: Turns in which the directions of the items alone are found.
OWN_TURNS = 3
ROUND_ITEMS = 400
ITEM_BYTES = 4 << 20
SHORT_ITEM = 5
COSINE = 0.45
#: Words with less weight (in more than one of 20 passages) are left out of the vectors,
#: but for items that would keep less than a quarter of their words, or fewer than SHORT_ITEM.
LEAST_WEIGHT = 3.0
#: Energy of the items in the fit, against that of the passages.
ITEM_SHARE = 4.0
#: Share of an item's weight that a passage must hold for the words to be compared.
HELD = 0.3
#: Share of an item's words that is a leak by itself, and with the answer.
COPIED, RETOLD, ANSWERED = 0.7, 0.5, 0.75


def term_classes() -> np.ndarray:
    """Letters, digits and all bytes beyond ASCII."""
    table = np.zeros(256, np.uint8)
    table[48:58] = table[65:91] = table[97:123] = 1
    table[128:] = 1
    return table


def cells_for(words: list[list[bytes]]) -> dict[bytes, int]:
    """Cell of every word of the items, in order of the alphabet; only beyond CELLS words do cells hold several."""
    return {w: i % CELLS for i, w in enumerate(sorted({w for own in words for w in own}))}


def begins(words: int) -> list[int]:
    """Where the windows of an item begin, at most half a passage apart; none for an item that fits in a passage."""
    rest = words - 2 * HALF
    steps = -(-rest // HALF)
    return [rest * n // steps for n in range(steps + 1)] if rest > 0 else []


def vectors_of(words: Column) -> Column:
    """Vectors of an item with that many words: itself and its windows."""
    return F.when(words > 2 * HALF, 2 + F.ceil((words - 2 * HALF) / HALF)).otherwise(1)


class Items:
    """Words and answers of the items of one round, and the parts of them that are compared with passages."""

    def __init__(self, ids: list, texts: list[str]):
        column = pa.array([t.lower() for t in texts], pa.large_string())
        tokens = Tokens(column, term_classes())
        self.ids, self.words, self.answers = [], [], []
        #: Ids and words of the items under SHORT_ITEM words.
        self.short: list[tuple[int, list[bytes]]] = []
        for row, text in enumerate(texts):
            words = [tokens.values[c] for c in tokens.code[tokens.first[row] : tokens.first[row + 1]]]
            if len(words) < SHORT_ITEM:
                if words:
                    self.short.append((ids[row], words))
                continue
            self.ids.append(ids[row])
            self.words.append(words)
            self.answers.append(self._answer(text, words))
        #: Words of each vector and its item: first the items, then the windows of the long ones.
        cut = [(row, own[b : b + 2 * HALF]) for row, own in enumerate(self.words) for b in begins(len(own))]
        self.owner = [*range(len(self.words)), *(row for row, _ in cut)]
        self.parts = [*self.words, *(own for _, own in cut)]
        self.cells = cells_for(self.words)
        #: Cells in use; vectors are no longer than that.
        self.size = min(CELLS, max(1, len(self.cells)))

    @staticmethod
    def _answer(text: str, words: list[bytes]) -> list[bytes]:
        last = [s for s in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if s.strip()][-1:]
        found = Tokens(pa.array([x.lower() for x in last], pa.large_string()), term_classes())
        answer = [found.values[c] for c in found.code]
        quarter = words[-max(3, len(words) // 4) :]
        return answer if 3 <= len(answer) <= len(words) // 2 else quarter

    def telling(self, weight: np.ndarray) -> dict[bytes, int]:
        """Cells of the words that the vectors are made of."""
        kept = weight >= LEAST_WEIGHT
        for words in self.parts:
            own = [self.cells[w] for w in words]
            if kept[own].sum() < max(SHORT_ITEM, len(own) / 4):
                kept[own] = True
        return {w: c for w, c in self.cells.items() if kept[c]}

    def vectors(self, weight: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
        """Vectors of the parts from ``low`` to ``high``."""
        parts = self.parts[low:high]
        out = np.zeros((len(parts), self.size), np.float32)
        for row, words in enumerate(parts):
            np.add.at(out[row], [self.cells[w] for w in words if w in self.cells], 1)
        return out * weight[: self.size]


def add_rows(out: np.ndarray, into: np.ndarray, rows: np.ndarray, which: np.ndarray) -> None:
    """Adds the rows ``which`` of ``rows`` to the rows ``into`` of ``out``; ``into`` ascends."""
    for low in range(0, len(which), PART_WORDS):
        target, source = into[low : low + PART_WORDS], which[low : low + PART_WORDS]
        at = np.arange(len(target))
        first = np.append(True, target[1:] != target[:-1])
        place = at - np.maximum.accumulate(np.where(first, at, 0))
        begin = np.flatnonzero(place % RUN_ROWS == 0)
        size = np.diff(np.append(begin, len(target)))
        # Longest first: the n-th rows of all runs are added together.
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        total = rows[source[begin]]
        for nth in range(1, int(size[0])):
            longer = int(np.searchsorted(-size, -nth))
            total[:longer] += rows[source[begin[:longer] + nth]]
        head = place[begin] == 0
        out[target[begin[head]]] += total[head]
        np.add.at(out, target[begin[~head]], total[~head])


def word_cells(values: list[bytes], cells: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((cells.get(v, -1) for v in values), np.int64, len(values))


class Passages:
    """Half passages of a column: the cells of the items' words in them."""

    def __init__(self, column: pa.Array, cells: dict[bytes, int]):
        """``column`` is text in lower case or, as binary, the codes that :func:`_coded` makes of it."""
        if pa.types.is_binary(column.type):
            data, at = _bytes(column)
            self.first, cell = at // 2, data.view(CODE).astype(np.int64) - 1
            telling = np.zeros(CELLS + 1, bool)
            telling[list(cells.values())] = True
            used = np.flatnonzero(telling[cell])
        else:
            tokens = Tokens(column, term_classes(), lower=False)
            self.first, cell = tokens.first, word_cells(tokens.values, cells)[tokens.code]
            used = np.flatnonzero(cell >= 0)
        count = -(-np.diff(self.first) // HALF)
        self.begin = np.cumsum(count) - count
        self.halves = int(count.sum())
        self.row = np.repeat(np.arange(len(count)), count)
        self.first_token = self.first[self.row] + (np.arange(self.halves) - self.begin[self.row]) * HALF
        row = np.repeat(np.arange(len(count)), np.diff(self.first))[used]
        self.cell = cell[used]
        self.half = self.begin[row] + (used - self.first[row]) // HALF

    def projected(self, directions: np.ndarray) -> np.ndarray:
        """Sum of the directions of the words of each half passage."""
        out = np.zeros((self.halves, directions.shape[1]), np.float32)
        add_rows(out, self.half, directions, self.cell)
        return out

    def joined(self, halves: np.ndarray) -> np.ndarray:
        """Each half with the one after it in the same text."""
        out = halves.copy()
        same = self.row[1:] == self.row[:-1]
        out[:-1][same] += halves[1:][same]
        return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows of a binary column and the row offsets in them, from 0."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def _coded(df: DataFrame, text: str, cells: dict[bytes, int], out: str) -> DataFrame:
    """``df`` with the cell of each word of the text, plus one, as ``out``; 0 for words that no item has."""
    lower = free_name(df, "__lower")
    lowered = df.withColumn(lower, F.lower(text))
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, lower, PART_BYTES):
                tokens = Tokens(part.column(lower), term_classes(), lower=False)
                code = (word_cells(tokens.values, known) + 1).astype(CODE)[tokens.code]
                held = [None, pa.py_buffer((2 * tokens.first).astype(np.int32)), pa.py_buffer(code.tobytes())]
                yield replaced(part, {out: pa.Array.from_buffers(pa.binary(), part.num_rows, held)}, (lower,))

    return map_arrow(lowered, task, with_fields(lowered, [T.StructField(out, T.BinaryType())], (lower,)))


def _frequencies(docs: DataFrame, text: str, cells: dict[bytes, int]) -> tuple[np.ndarray, float]:
    """Weights of all cells, inverse frequency over all half passages of all texts, and their number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS + 1)
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                found = Passages(part.column(text), cells)
                pairs = np.unique(found.half * CELLS + found.cell)
                counts[:CELLS] += np.bincount(pairs % CELLS, minlength=CELLS)
                counts[CELLS] += found.halves
        yield from emitted({"df": counts})

    counts = whole(summed(map_arrow(docs.select(text), task, SCHEMA)).get("df"), CELLS + 1)
    return np.log((counts[CELLS] + 2) / (counts[:CELLS] + 1)).astype(np.float32), counts[CELLS]


def _directions(docs: DataFrame, text: str, items: Items, weight: np.ndarray, passages: float) -> np.ndarray:
    """Cells x RANK: weights times the main directions of all ``passages`` of ``docs`` and of the items."""
    cells = items.cells
    # Items weigh ITEM_SHARE times as much as all passages, else the directions
    # would tell passages from each other but not items.
    share = ITEM_SHARE * max(1.0, passages) / max(1, len(items.parts))

    def of_items(q: np.ndarray) -> np.ndarray:
        """Transposed items and windows times themselves times ``q``, some of them at a time."""
        total = np.zeros(q.shape)
        for low in range(0, len(items.parts), ROUND_ITEMS):
            own = items.vectors(weight, low, low + ROUND_ITEMS)
            own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
            total += own.T.astype(float) @ (own @ q)
        return share * total

    def of_passages(q: np.ndarray) -> np.ndarray:
        """The same for all passages of all texts."""
        shared = docs.sparkSession.sparkContext.broadcast((cells, (q * weight[: items.size, None]).astype(np.float32), weight))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, weighted, w = shared.value
            total = np.zeros(weighted.shape)
            for batch in batches:
                for part in slices(batch, text, PART_BYTES):
                    found = Passages(part.column(text), cells)
                    if not len(found.cell):
                        continue
                    square = np.bincount(found.half, w[found.cell].astype(float) ** 2, found.halves)
                    made = found.projected(weighted) / np.maximum(square, 1e-9)[:, None].astype(np.float32)
                    order = np.argsort(found.cell, kind="stable")
                    add_rows(total, found.cell[order], made, found.half[order])
            yield from emitted({"y": (total * w[: len(total), None]).ravel()})

        return whole(summed(map_arrow(docs.select(text), task, SCHEMA)).get("y"), q.size).reshape(q.shape)

    start = np.linalg.qr(np.random.default_rng(11).normal(size=(items.size, min(items.size, RANK + EXTRA))))[0]
    basis = start
    for _ in range(OWN_TURNS):
        made = of_items(basis)
        # A little of the start stays, for there may be fewer items than directions.
        basis = np.linalg.qr(made / max(1e-9, np.abs(made).max()) + 1e-4 * start)[0]
    made = of_items(basis) + of_passages(basis)
    values, turn = np.linalg.eigh(basis.T @ made)
    kept = values > 1e-9 * max(1e-9, values.max())
    main = np.linalg.svd(made @ (turn[:, kept] / np.sqrt(values[kept])), full_matrices=False)[0][:, :RANK]
    return (main * weight[: items.size, None]).astype(np.float32)


def common_length(masks: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of ``words`` with the item that ``masks`` describes."""
    row = full = (1 << size) - 1
    for word in words:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def masks_of(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << i
    return out


class Checker:
    """Word checks of one item."""

    def __init__(self, words: list[bytes], answer: list[bytes]):
        self.sequence, self.size, self.answer_size = words, len(words), len(answer)
        self.words, self.answer = masks_of(words), masks_of(answer)

    def shares(self, text: list[bytes]) -> tuple[float, float]:
        """Best share of the item in a stretch of about its length, and the answer's share there."""
        best, at = -1, 0
        length, step = self.size + self.size // 4, max(1, self.size // 4)
        for low in range(0, max(1, len(text) - length + step), step):
            found = common_length(self.words, self.size, text[low : low + length])
            if found > best:
                best, at = found, low
        near = text[max(0, at - step) : at + length + step]
        return best / self.size, common_length(self.answer, self.answer_size, near) / max(1, self.answer_size)


class Sequences:
    """Short items as a tree of words, followed from all words of a batch at once."""

    def __init__(self, short: list[tuple[int, list[bytes]]]):
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for _, own in short for w in own}))}
        steps: dict[int, int] = {}
        self.ids: dict[int, list[int]] = {}
        for ident, own in short:
            state = 0
            for word in own:
                state = steps.setdefault(self._key(state, self.number[word]), len(steps) + 1)
            self.ids.setdefault(state, []).append(ident)
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)

    def _key(self, state, number):
        return state * (len(self.number) + 1) + number

    def found(self, tokens: Tokens) -> dict[int, list[dict]]:
        """Leaks of each row."""
        out: dict[int, list[dict]] = {}
        if not len(self.keys) or not len(tokens.code):
            return out
        number = np.fromiter((self.number.get(v, 0) for v in tokens.values), np.int64, len(tokens.values))[tokens.code]
        at = np.flatnonzero(number)
        state = np.zeros(len(at), np.int64)
        for depth in range(SHORT_ITEM - 1):
            key = self._key(state, number[at + depth])
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[place] == key
            at, state = at[on], self.next[place[on]]
            for row, end in sorted(set(zip(tokens.row[at].tolist(), state.tolist()))):
                for ident in self.ids.get(end, []):
                    out.setdefault(row, []).append({"item_id": ident, "cosine": 1.0, "item_share": 1.0, "answer_share": 1.0})
            inside = at + depth + 1 < tokens.first[tokens.row[at] + 1]
            at, state = at[inside], state[inside]
        return out


FOUND = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()),
    T.StructField("item_share", T.DoubleType()), T.StructField("answer_share", T.DoubleType()),
]))


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", out: str = "leaks", cosine: float = COSINE) -> DataFrame:
    """``df`` with the items that leak into each text as ``out`` (array of item_id, cosine, item_share, answer_share)."""
    spark = df.sparkSession
    rows = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("x")).filter("id IS NOT NULL AND x IS NOT NULL")
    number, size = rows.agg(
        F.coalesce(F.sum(vectors_of(F.regexp_count("x", F.lit(WORD)))), F.lit(0)), F.coalesce(F.sum(F.octet_length("x")), F.lit(0))
    ).first()
    rounds = max(1, -(-number // ROUND_ITEMS), -(-size // ITEM_BYTES))
    found, coded = df.withColumn(out, F.array().cast(FOUND)), None
    for nth in range(rounds):
        part = rows.filter(F.pmod(F.xxhash64("id", "x"), F.lit(rounds)) == nth).collect() if rounds > 1 else rows.collect()
        part = sorted(part, key=lambda r: (r.id, r.x))
        items = Items([r.id for r in part], [r.x for r in part])
        if not items.ids and not items.short:
            continue
        codes = free_name(found, "__codes")
        before, coded = coded, stored(_coded(found, text, items.cells, codes), "leak-codes")
        if before is not None:
            deleted(spark, before)
        directions = np.zeros((1, 1), np.float32)
        if items.ids:
            weight, halves = _frequencies(coded, codes, items.cells)
            items.cells = items.telling(weight)
            directions = _directions(coded, codes, items, weight, halves)
        shared = spark.sparkContext.broadcast((items.short, items.ids, items.words, items.answers, items.owner, items.parts, items.cells, directions))
        found = _searched(coded, text, codes, shared, out, cosine)
    return found


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has it."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def _searched(df: DataFrame, text: str, codes: str, shared, out: str, cosine: float) -> DataFrame:
    lower = free_name(df, "__lower")
    lowered = df.withColumn(lower, F.lower(text))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, ids, words, answers, owner, parts, cells, directions = shared.value
        items = np.zeros((len(parts), directions.shape[1]), np.float32)
        for row, own in enumerate(parts):
            items[row] = directions[[cells[w] for w in own if w in cells]].sum(0)
        checkers = [Checker(w, a) for w, a in zip(words, answers)]
        sequences = Sequences(short)
        for batch in batches:
            for part in slices(batch, lower, PART_BYTES):
                passages = Passages(part.column(codes), cells)
                near = _candidates(passages, directions, items, cosine)
                # Words are needed of texts with a candidate; short items have no candidates.
                rows = np.arange(part.num_rows) if short else np.unique(passages.row[np.array([half for half, _, _ in near], np.int64)])
                tokens = Tokens(part.column(lower).take(pa.array(rows, pa.int64())), term_classes(), lower=False)
                leaks = _checked(passages, rows, tokens, [(half, owner[row], c) for half, row, c in near], checkers, ids)
                for row, more in sequences.found(tokens).items():
                    leaks[row] = leaks.get(row, []) + more
                old = part.column(out).to_pylist()
                yield replaced(part, {out: pa.array([o + leaks.get(row, []) for row, o in enumerate(old)], schema.field(out).type)}, (lower, codes))

    fields = with_fields(lowered, [T.StructField(out, FOUND)], (lower, codes))
    schema = pa.schema([pa.field(out, pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("item_share", pa.float64()), ("answer_share", pa.float64())])))])
    return map_arrow(lowered, task, fields)


def _candidates(passages: Passages, directions: np.ndarray, items: np.ndarray, cosine: float) -> list[tuple[int, int, float]]:
    """Half passage, row of ``items`` and cosine of all passages near an item or window."""
    halves = passages.projected(directions)
    length = np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-9)
    out: list[tuple[int, int, float]] = []
    if not len(items):
        return out
    for made in (halves, passages.joined(halves)):
        size = np.linalg.norm(made, axis=1)
        # A shorter passage can't hold enough of any item, whatever its direction.
        long_enough = np.flatnonzero(size >= HELD * length.min())
        step = max(1, ROUND_ITEMS * PART_PASSAGES // max(ROUND_ITEMS, len(items)))
        for low in range(0, len(long_enough), step):
            at = long_enough[low : low + step]
            near = made[at] @ (items / length).T
            half, item = np.nonzero(near >= np.maximum(cosine * size[at, None], HELD * length.T))
            out += zip(at[half].tolist(), item.tolist(), (near[half, item] / size[at[half]]).tolist())
    return out


def _checked(passages: Passages, rows: np.ndarray, tokens: Tokens, near: list[tuple[int, int, float]], checkers: list[Checker], ids: list[int]) -> dict[int, list[dict]]:
    """Leaks of each row; ``tokens`` are those of the texts ``rows``, in ascending order."""
    best: dict[tuple[int, int], dict] = {}
    seen: set[tuple[int, int]] = set()
    number = {v: c for c, v in enumerate(tokens.values)} if near else {}
    codes: dict[int, list[int]] = {}
    for half, item, cosine in sorted(near, key=lambda x: -x[2]):
        row = int(passages.row[half])
        if (half, item) in seen:
            continue
        seen.add((half, item))
        known = best.get((row, item))
        if known and known["item_share"] >= 0.95:
            continue
        checker = checkers[item]
        own = int(np.searchsorted(rows, row))
        begin = tokens.first[own] + passages.first_token[half] - passages.first[row]
        low = max(tokens.first[own], begin - checker.size)
        high = min(tokens.first[own + 1], begin + 2 * HALF + checker.size)
        if item not in codes:
            codes[item] = [number.get(w, -1) for w in checker.sequence]
        # No subsequence is longer than the words that are there in any order.
        here = set(tokens.code[low:high].tolist())
        if sum(c in here for c in codes[item]) < RETOLD * checker.size:
            continue
        share, answer = checker.shares([tokens.values[c] for c in tokens.code[low:high]])
        if (share >= COPIED or share >= RETOLD and answer >= ANSWERED) and (not known or share > known["item_share"]):
            best[row, item] = {"item_id": ids[item], "cosine": cosine, "item_share": share, "answer_share": answer}
    out: dict[int, list[dict]] = {}
    for (row, _), leak in sorted(best.items(), key=lambda x: (x[0][0], x[1]["item_id"])):
        out.setdefault(row, []).append(leak)
    return out
