"""Byte-level BPE by corpus-level merge replay.

The words of a block of documents (a few hundred thousand distinct words) are one
corpus. An inverted index leads from the rank of a token pair to the positions of
that pair in all words. Merges are applied in rank order over the whole corpus, and
after each one only the pairs left and right of the merged positions are looked up
again; where a merge makes one of a lower rank possible, the rest of its word waits for that.
Every distinct word is encoded once a block, however often it occurs, and no
row is shuffled: the vocabulary is the only thing that all tasks share.

Defined results: NULL and empty text give no ids and decode to no bytes; repeated
rows are encoded alike; other columns pass through, one that has the name of an
output column is replaced; ids outside the vocabulary are an error when decoding;
a NULL list of ids decodes to no bytes, NULL ids in a list are skipped; a very long text
is encoded whole, its words numbered a million at a time.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldsurvey.llm.arrow import map_arrow, replaced, with_fields

# A vocabulary is sent to every executor; this bounds it.
MAX_RANK_FILE = 64 << 20
# A block ends at so many new words or so many words in its texts.
BLOCK_WORDS = 100_000
BLOCK_PIECES = 1_000_000
# Words whose ids a task remembers between blocks.
KEPT_WORDS = 100_000
# Rows that are decoded at once, since a list of ids can be long.
DECODED_ROWS = 1_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of lines ``base64 id`` with ids from 0."""
    with open(path, "rb") as file:
        content = file.read(MAX_RANK_FILE + 1)
    if len(content) > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    pairs = [line.split() for line in content.splitlines() if line]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class MergeTable:
    """Which neighbouring tokens merge, and into what: one entry for every split of a token in two tokens."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.rank = {t: i for i, t in enumerate(tokens)}
        found = [
            (left * self.size + right, i)
            for i, t in enumerate(tokens)
            for k in range(1, len(t))
            if (left := self.rank.get(t[:k])) is not None and (right := self.rank.get(t[k:])) is not None
        ]
        found.sort()
        self.pairs = np.array([p for p, _ in found] or [-1], np.int64)
        self.into = np.array([i for _, i in found] or [-1], np.int64)
        # Tokens that, once made, may allow a merge of a lower rank than their own.
        left, right = np.divmod(self.pairs, self.size)
        self.opens = {*left[left > self.into].tolist(), *right[right > self.into].tolist()}
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.into[at], -1)


def replay(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many each word has."""
    whole = np.fromiter((table.rank.get(w, -1) for w in words), np.int64, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    todo = np.flatnonzero((whole < 0) & (lengths > 0))
    # One cell for each byte; a cell is empty once it was merged into the one before it.
    size = lengths[todo]
    word = np.repeat(np.arange(len(todo)), size)
    token = table.byte[np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)]
    if (token < 0).any():
        raise ValueError("the vocabulary lacks a token for a single byte")
    n = len(token)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    if n:
        ends = np.cumsum(size)
        after[ends - 1] = n
        before[ends - size] = -1
    token, after, before = np.append(token, 0), np.append(after, n), np.append(before, -1)
    alive = np.ones(n + 1, bool)
    alive[n] = False
    here = np.flatnonzero(after[:n] < n)
    rank = np.full(n + 1, -1, np.int64)
    rank[here] = table.lookup(token[here], token[after[here]])

    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(positions: np.ndarray) -> None:
        """Puts positions under the rank of the pair that begins there."""
        ranks = rank[positions]
        if len(positions) > 1:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            groups = zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts))
        else:
            groups = zip(ranks.tolist(), [positions] * len(ranks))
        for r, group in groups:
            if r in index:
                index[r].append(group)
            else:
                index[r] = [group]
                heapq.heappush(queue, r)

    enter(here[rank[here] >= 0])
    while queue:
        r = heapq.heappop(queue)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        # A pair of two equal tokens may overlap the next one: of a run of neighbours every second stays.
        if len(at) > 1 and (overlap := after[at[:-1]] == at[1:]).any():
            begins = np.append(True, ~overlap)
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
        waiting = np.zeros(0, np.int64)
        if r in table.opens:
            # In a word that gets a pair of a lower rank the later positions wait until that was merged.
            on = allowed(at, r, token, after, before, word, table, n)
            waiting = np.unique(word[at[~on]])
            at = at[on]
        gone = after[at]
        beyond = after[gone]
        token[at] = r
        alive[gone] = False
        after[at] = beyond
        before[beyond] = at
        before[n] = -1
        touched = np.concatenate([at[beyond < n], (left := before[at])[left >= 0]])
        rank[at] = -1
        touched = np.unique(touched) if len(touched) > 1 else touched
        rank[touched] = table.lookup(token[touched], token[after[touched]])
        fresh = touched[rank[touched] >= 0]
        if len(waiting):
            fresh = np.unique(np.concatenate([fresh, at_rank(rank, alive, word, r, waiting)]))
        if len(fresh):
            enter(fresh)
    counts = np.where(lengths > 0, 1, 0)
    counts[todo] = np.bincount(word[alive[:n]], minlength=len(todo))
    out = np.empty(int(counts.sum()), np.int64)
    begin = np.cumsum(counts) - counts
    one = np.flatnonzero(whole >= 0)
    out[begin[one]] = whole[one]
    if n:
        live = np.flatnonzero(alive[:n])
        inside = np.arange(len(live)) - np.repeat(np.cumsum(counts[todo]) - counts[todo], counts[todo])
        out[np.repeat(begin[todo], counts[todo]) + inside] = token[live]
    return out, counts


def allowed(
    at: np.ndarray, r: int, token: np.ndarray, after: np.ndarray, before: np.ndarray, word: np.ndarray, table: MergeTable, n: int
) -> np.ndarray:
    """Which merges at positions ``at`` come before their word has a pair of a lower rank than ``r``."""
    left, beyond = before[at], after[after[at]]
    # Left of a position the merge before it may be done already, right of it none is.
    beside = token[left]
    beside[1:][after[at[:-1]] == left[1:]] = r
    new = np.stack([
        np.where(left >= 0, table.lookup(beside, np.full(len(at), r)), -1),
        np.where(beyond < n, table.lookup(np.full(len(at), r), token[beyond]), -1),
    ])
    lower = ((new >= 0) & (new < r)).any(0)
    earlier = np.cumsum(lower) - lower
    first = np.append(True, word[at[1:]] != word[at[:-1]])
    return earlier == np.maximum.accumulate(np.where(first, earlier, 0))


def at_rank(rank: np.ndarray, alive: np.ndarray, word: np.ndarray, r: int, words: np.ndarray) -> np.ndarray:
    """Positions of ``words`` whose pair has rank ``r``."""
    lo, hi = np.searchsorted(word, words), np.searchsorted(word, words, "right")
    cells = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)]) if len(words) else np.zeros(0, np.int64)
    return cells[alive[cells] & (rank[cells] == r)]


class Words(dict):
    """Number of each distinct word, given in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes blocks of texts; remembers the ids of words between blocks."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.table, self.pattern = MergeTable(tokens), regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.words = Words()
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        """The words of a text by number."""
        number = self.words.__getitem__
        if len(text) < 1 << 20:
            return np.array([number(w) for w in self.pattern.findall(text)], np.int32)
        parts, matches = [], self.pattern.finditer(text)
        while part := [number(m[0]) for m in islice(matches, 1 << 20)]:
            parts.append(np.array(part, np.int32))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def finish(self, texts: list[np.ndarray]) -> pa.ListArray:
        """Ids of texts whose words were numbered before."""
        new = [w.encode() for w in islice(self.words, len(self.counts), None)]
        ids, counts = replay(new, self.table)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.counts = np.concatenate([self.counts, counts])
        begin = np.cumsum(self.counts) - self.counts
        number = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        each = self.counts[number]
        ends = np.zeros(len(number) + 1, np.int64)
        np.cumsum(each, out=ends[1:])
        flat = self.ids[np.repeat(begin[number] - ends[:-1], each) + np.arange(ends[-1])]
        offsets = ends[np.cumsum([0, *map(len, texts)])]
        return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(pa.list_(pa.int32()))


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep_text: bool = True
) -> DataFrame:
    """``df`` with the token ids of its whole texts as ``ids`` (array of int).

    Each match of ``pattern`` is encoded by itself, without special tokens. With ``decoded`` the same
    task also decodes the ids (see :func:`decode`), so that it needs no second Python worker.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, pattern)
        tokens = pa.array(vocabulary.value, pa.large_binary()) if decoded else None
        rows: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        pieces = 0

        def block() -> Iterator[pa.RecordBatch]:
            found, begin = encoder.finish(texts), 0
            for part in rows:
                for low in range(0, part.num_rows, DECODED_ROWS) if decoded else (0,):
                    piece = part.slice(low, DECODED_ROWS) if decoded else part
                    own = found.slice(begin, piece.num_rows)
                    begin += piece.num_rows
                    out = {ids: own, decoded: decoded_bytes(own, tokens)} if decoded else {ids: own}
                    yield replaced(piece, out, dropped)
            if len(encoder.words) > KEPT_WORDS:
                encoder.forget()
            rows.clear()
            texts.clear()

        for batch in batches:
            begin = 0
            for row, value in enumerate(batch.column(text)):
                texts.append(encoder.numbers(value.as_py() or ""))
                pieces += len(texts[-1])
                if pieces >= BLOCK_PIECES or len(encoder.words) - len(encoder.counts) >= BLOCK_WORDS:
                    rows.append(batch.slice(begin, row + 1 - begin))
                    begin, pieces = row + 1, 0
                    yield from block()
            if begin < batch.num_rows:
                rows.append(batch.slice(begin))
        if rows:
            yield from block()

    dropped = () if keep_text else (text,)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    return map_arrow(df, task, with_fields(df, fields, dropped))


def decoded_bytes(lists: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The bytes of each list of ids."""
    flat = lists.flatten()
    each = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    row = np.repeat(np.arange(len(each)), each)
    if flat.null_count:
        row = row[~np.asarray(flat.is_null())]
        flat = flat.drop_null()
    values = tokens.take(flat)
    data = values.buffers()[2]
    size = np.diff(np.frombuffer(values.buffers()[1], np.int64)[: len(flat) + 1]) if len(flat) else np.zeros(0)
    ends = np.zeros(len(each) + 1, np.int64)
    np.cumsum(np.bincount(row, size, len(each)), out=ends[1:])
    out = pa.Array.from_buffers(pa.large_binary(), len(each), [None, pa.py_buffer(ends), data or pa.py_buffer(b"")])
    return out.cast(pa.binary())


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the token ids as ``decoded``."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(vocabulary.value, pa.large_binary())
        for batch in (b.slice(low, DECODED_ROWS) for b in batches for low in range(0, b.num_rows, DECODED_ROWS)):
            yield replaced(batch, {decoded: decoded_bytes(batch.column(ids), tokens)})

    return map_arrow(df, task, with_fields(df, [T.StructField(decoded, T.BinaryType())]))
