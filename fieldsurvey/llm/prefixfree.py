"""Repeated strings of a corpus by prefix-free parsing, on bytes.

A rolling hash of a few bytes makes a position a trigger, and triggers cut texts into phrases.
Equal strings have equal triggers inside, wherever they stand, so repetitive text has few
distinct phrases. No phrase is the beginning of another one, hence text positions are in
order once the suffixes of the dictionary are in order and, where those are equal, the parse
suffixes that follow them. A string of ``length`` bytes is repeated where a neighbour in this
order shares that many bytes, which takes no more than the common prefixes of the parse.

On Spark the order is made in parts that can't have a repeated string between them:

1. Texts are packed into blocks (see ``blocks``). An item is the run of phrases from a trigger
   that covers ``ITEM`` bytes; items are counted over the corpus. A string with an item that
   occurs once is not repeated, which ends most texts here.
2. Every other string belongs to its rarest item, its anchor. The strings of one occurrence of
   an anchor are one segment of text. A block sends its distinct segments to the range of the
   hash of their anchor, so equal strings meet, whatever surrounds them.
3. A range sorts the suffixes of its dictionary and of its parse, a bounded number of anchors at
   a time, and answers each segment with the strings that are repeated.
4. Strings of which even the rarest item is common (more than ``COMMON`` times), and strings
   without an item (few triggers), are told apart by the hash of the whole string. A block sends
   each hash once, so that a passage in a third of all texts is no hot key.
5. A block removes every byte under a repeated string.

Phrases, items and strings are told apart by 64-bit hashes of their bytes.

Defined results: NULL texts are empty; texts shorter than ``length`` stay as they are; strings
never cross texts, and repeats within a text count; repeated rows are texts each, hence
remove each other; what is kept may cut a character in two and is binary; a very long text is one
block, with work space of about a hundred times its bytes in one task; other columns pass through,
those named like a new column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsurvey.llm.arrow import mixed, replaced, text_bytes, with_fields
from fieldsurvey.llm.blocks import (
    RANGE_BYTES,
    Items,
    deleted,
    joined,
    pack,
    packed_array,
    packed_rows,
    packed_sorted,
    ranges_for,
    stored,
    totals,
    unpacked_array,
    unpacked_rows,
    unpacked_sorted,
)

LENGTH = 400
#: Bytes of a trigger, and one position in how many is one.
WINDOW, EVERY = 12, 32
#: Least bytes of an item.
ITEM = 48
#: Occurrences from which on an item is too common for an anchor.
COMMON = 1_000
#: Distinct segments sorted at once.
SORTED_BYTES = 2 << 20
#: Ranges of segments for each range of items.
SEGMENT_RANGES = 2
#: Compression of what is written and shuffled.
LEVEL = 6
SEGMENTS, STRINGS, PLAN = 0, 1, 2
SENT = "kind int, range int, block long, data binary"
FACTS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("kept", T.BinaryType()),
]
#: An odd multiplier, and its inverse among 64-bit numbers.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 2**64)
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


class Rolling:
    """Polynomial hashes of all substrings of ``data``."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.full(n, BASE, np.uint64)
        back = np.full(n + 1, UNBASE, np.uint64)
        power[:1], back[0] = 1, 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * np.cumprod(power, dtype=np.uint64), dtype=np.uint64, out=self.sums[1:])
        self.back = np.cumprod(back, dtype=np.uint64)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.back[start] + np.asarray(length).astype(np.uint64))

    def triggers(self, offsets: np.ndarray) -> np.ndarray:
        """Positions whose next ``WINDOW`` bytes, all of the same text, hash to a multiple."""
        n = len(self.sums) - WINDOW
        if n <= 0:
            return np.zeros(0, np.int64)
        rolled = (self.sums[WINDOW:] - self.sums[:n]) * self.back[:n]
        at = np.flatnonzero((rolled * np.uint64(BASE)) >> np.uint64(40) < np.uint64((1 << 24) // EVERY))
        return at[at + WINDOW <= offsets[np.searchsorted(offsets, at, "right")]]


class Parsed:
    """Triggers and items of the texts of a block; hashes of items have ``bits`` bits, the upper ones."""

    def __init__(self, column: pa.Array, bits: int = 64):
        self.data, self.offsets = text_bytes(column)
        self.rolling = Rolling(self.data)
        at = self.rolling.triggers(self.offsets)
        # The first trigger that makes an item long enough ends it, if it is in the same text.
        last = np.searchsorted(at, at + ITEM)
        begin = np.flatnonzero(last < len(at))
        end = at[last[begin]] + WINDOW
        fits = end <= np.minimum(self.offsets[np.searchsorted(self.offsets, at[begin], "right")], at[begin] + LENGTH)
        self.start, self.end = at[begin][fits], end[fits]
        self.hash = self.rolling.of(self.start, self.end - self.start) >> np.uint64(64 - bits) << np.uint64(64 - bits)

    def items(self) -> Items:
        found, count = np.unique(self.hash, return_counts=True)
        return {0: (found, count)}

    def runs(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Consecutive strings of one kind: first string, number, and the anchor's item or -1.

        Strings with an item that occurs once are left out.
        """
        size = np.diff(self.offsets)
        long = np.flatnonzero(size >= LENGTH)
        first, after = self.offsets[:-1][long], self.offsets[:-1][long] + size[long] - LENGTH + 1
        cut = np.unique(np.concatenate([self.start + 1, np.maximum(self.end - LENGTH, 0), first, after]))
        text = np.searchsorted(first, cut, "right") - 1
        held = (text >= 0) & (cut < after[text]) if len(first) else np.zeros(len(cut), bool)
        begin = cut[held]
        number = (np.append(cut[1:], cut[-1:]) - cut)[held]
        low, high = np.searchsorted(self.start, begin), np.searchsorted(self.end, begin + LENGTH, "right")
        anchor = np.full(len(begin), -1)
        some = np.flatnonzero(high > low)
        if len(some):
            order = np.lexsort((self.hash, count))
            new = np.append(False, (self.hash[order][1:] != self.hash[order][:-1]) | (count[order][1:] != count[order][:-1]))
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new)
            # The leftmost of equal items.
            value = np.append(place * len(place) + np.arange(len(place)), np.iinfo(np.int64).max)
            least = np.minimum.reduceat(value, np.stack([low[some], high[some]], 1).ravel())[::2]
            anchor[some] = least % len(place)
        alive = (anchor < 0) | (count[anchor] > 1) if len(count) else np.ones(len(begin), bool)
        begin, number, anchor = begin[alive], number[alive], anchor[alive]
        fresh = np.ones(len(begin), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + number[:-1])
        at = np.flatnonzero(fresh)
        return begin[at], np.add.reduceat(number, at) if len(at) else number, anchor[at]


def every(begin: np.ndarray, number: np.ndarray) -> np.ndarray:
    """All positions of runs."""
    ends = np.cumsum(number)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - number), number)


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def to_send(block: int, rows: pa.RecordBatch, text: str, counts: np.ndarray, ranges: int, bits: int = 64) -> pa.Table:
    """SENT rows of a block: its segments, its single strings, and where they stand."""
    parsed = Parsed(rows.column(text), bits)
    count = counts[np.searchsorted(np.unique(parsed.hash), parsed.hash)] if len(parsed.hash) else np.zeros(0, np.int64)
    begin, number, anchor = parsed.runs(count)
    rare = np.append(count, COMMON + 1)[anchor] <= COMMON
    out = []
    # Segments, each once, in order of their ranges.
    start, length, of = begin[rare], number[rare] + LENGTH - 1, anchor[rare]
    key = mixed(parsed.rolling.of(start, length) + mixed((parsed.start[of] - start).astype(np.uint64)))
    _, lead, segment, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    to = range_of(parsed.hash[of[lead]], ranges)
    order = np.argsort(to, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    strings = number[rare][lead][order]
    bits = []
    for target, at, past in _grouped(to[order]):
        mine = order[at:past]
        bits.append(strings[at:past].sum())
        out.append((SEGMENTS, target, packed_rows(pa.RecordBatch.from_arrays([
            pa.array(parsed.hash[of[lead[mine]]]), pa.array(key[lead[mine]]), pa.array(times[mine] > 1),
            pa.array([parsed.data[s : s + n].tobytes() for s, n in zip(start[lead[mine]], length[lead[mine]])], pa.binary()),
        ], ["anchor", "key", "many", "bytes"]), LEVEL)))
    # Single strings by hash, each once.
    single = every(begin[~rare], number[~rare])
    hashes, string, seen = np.unique(parsed.rolling.of(single, LENGTH), return_inverse=True, return_counts=True)
    bits1 = []
    for target, at, past in _grouped(range_of(hashes, ranges)):
        data = packed_sorted(hashes[at:past]), packed_array(np.minimum(seen[at:past], 2))
        bits1.append(past - at)
        out.append((STRINGS, target, len(data[0]).to_bytes(8, "little") + data[0] + data[1]))
    base = (np.cumsum(strings) - strings)[place]
    arrays = [begin[rare], number[rare], base[segment], np.array(bits, np.int64), begin[~rare], number[~rare], string, np.array(bits1, np.int64)]
    out.append((PLAN, 0, packed_rows(pa.RecordBatch.from_arrays([pa.array([packed_array(a) for a in arrays], pa.binary())], ["arrays"]))))
    kind, to_, data = zip(*out)
    return pa.table({
        "kind": pa.array(kind, pa.int32()), "range": pa.array(to_, pa.int32()), "block": pa.array([block] * len(out)), "data": pa.array(data, pa.binary()),
    })


def _grouped(numbers: np.ndarray):
    """Value, begin and end of each run of equal sorted numbers."""
    at = np.flatnonzero(np.diff(numbers.astype(np.int64), prepend=-1))
    return zip(numbers[at].tolist(), at.tolist(), np.append(at[1:], len(numbers)).tolist())


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as a number that sorts like them; zeros beyond the end."""
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def dictionary_order(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rank of each string (equal for equal ones) among all, eight bytes at a time; a beginning comes first."""
    rank = np.zeros(len(start), np.int64)
    open_ = np.arange(len(start))
    depth = 0
    while len(open_):
        left = np.clip(length[open_] - depth, 0, 8)
        at = np.minimum(start[open_] + depth, len(words) - 1)
        shift = ((8 - left) * 8).astype(np.uint64)
        word = np.where(left > 0, words[at] >> np.minimum(shift, 63) << np.minimum(shift, 63), 0).astype(np.uint64)
        order = np.lexsort((left, word, rank[open_]))
        old, word, left, row = rank[open_][order], word[order], left[order], open_[order]
        group = np.append(True, old[1:] != old[:-1]) if len(old) else np.zeros(0, bool)
        fresh = group.copy()
        fresh[1:] |= (word[1:] != word[:-1]) | (left[1:] != left[:-1])
        index = np.arange(len(row))
        head = np.maximum.accumulate(np.where(group, index, 0))
        lead = np.maximum.accumulate(np.where(fresh, index, 0))
        rank[row] = old + lead - head
        size = np.diff(np.append(np.flatnonzero(fresh), len(row)))
        tied = np.repeat(size, size) > 1
        open_ = row[tied & (left == 8)]
        depth += 8
    return rank


def parse_order(rank: np.ndarray, last: np.ndarray, cap: int) -> np.ndarray:
    """Parse positions in order of the phrases from them to the end of their segment, by doubling."""
    place = np.unique(rank, return_inverse=True)[1]
    n, step = len(rank), 1
    while step <= cap and place.max() + 1 < n:
        ahead = np.arange(n) + step
        follow = np.where(ahead <= last, place[np.minimum(ahead, n - 1)] + 1, 0)
        place = np.unique(place * (n + 1) + follow, return_inverse=True)[1]
        step *= 2
    return np.argsort(place, kind="stable")


def common_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the strings at ``a`` and ``b``, up to ``limit``."""
    out = np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(limit > 0)
    while len(open_):
        at = out[open_]
        differ = words[a[open_] + at] ^ words[b[open_] + at]
        equal = np.zeros(len(open_), np.int64)
        for bits in range(56, -1, -8):
            equal += differ < np.uint64(1 << bits)
        out[open_] = np.minimum(at + equal, limit[open_])
        open_ = open_[(equal == 8) & (out[open_] < limit[open_])]
    return out


class Minima:
    """Smallest value of any stretch of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values.astype(np.int16)]
        while (half := 1 << len(self.levels) - 1) * 2 <= len(values):
            held = self.levels[-1]
            self.levels.append(np.minimum(held[:-half], held[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(first), np.int16)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return out


def repeated(segments: list[bytes]) -> list[np.ndarray]:
    """For each segment which of its strings, by their first byte, occur in another place of any segment."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    offsets = np.cumsum([0, *map(len, segments)])
    rolling, words = Rolling(data), words_of(data)
    # Phrases begin at a trigger, or with their segment, and end with the next trigger or the segment.
    begin = np.union1d(rolling.triggers(offsets), offsets[:-1])
    owner = np.searchsorted(offsets, begin, "right") - 1
    inner = np.append(owner[1:] == owner[:-1], False)
    end = np.where(inner, np.append(begin[1:], 0) + WINDOW, offsets[owner + 1])
    _, lead, phrase = np.unique(rolling.of(begin, end - begin), return_index=True, return_inverse=True)
    # Suffixes of distinct phrases that are longer than a trigger, and whole phrases.
    size = (end - begin)[lead]
    number = np.maximum(size - WINDOW, 1)
    base = np.cumsum(number) - number
    start = every(begin[lead], number)
    rank = dictionary_order(words, start, np.repeat(end[lead], number) - start)
    last = np.flatnonzero(~inner)[owner] if len(begin) else begin
    cap = int((np.searchsorted(begin, begin + LENGTH) - np.arange(len(begin))).max())
    order = parse_order(rank[base][phrase], last, cap)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    room = np.minimum(LENGTH, offsets[owner + 1] - begin)[order]
    shared = common_bytes(words, begin[order][:-1], begin[order][1:], np.minimum(room[:-1], room[1:]))
    minima = Minima(np.append(0, shared))
    # Strings in corpus order: by the suffix of their phrase, then by the parse from the next trigger on.
    string = every(offsets[:-1], np.diff(offsets) - LENGTH + 1)
    own = np.searchsorted(begin, string, "right") - 1
    suffix = rank[base[phrase[own]] + string - begin[own]]
    follow = place[own + 1]
    left = LENGTH - (begin[own + 1] - string)
    sorted_ = np.argsort(suffix * len(begin) + follow)
    suffix, follow, left = suffix[sorted_], follow[sorted_], left[sorted_]
    pair = np.flatnonzero(suffix[1:] == suffix[:-1])
    met = minima.of(follow[pair] + 1, follow[pair + 1]) >= left[pair]
    flags = np.zeros(len(string), bool)
    flags[sorted_[pair[met]]] = True
    flags[sorted_[pair[met] + 1]] = True
    return np.split(flags, np.cumsum(np.diff(offsets) - LENGTH + 1)[:-1])


def answer_segments(data: list[bytes]) -> list[bytes]:
    """Bits of the repeated strings of all segments of each block."""
    sent = [unpacked_rows(d) for d in data]
    key = np.concatenate([r.column("key").to_numpy() for r in sent])
    _, lead, number, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    many = np.concatenate([r.column("many").to_numpy(zero_copy_only=False) for r in sent])
    many = (np.bincount(number, many, len(lead)) > 0) | (times > 1)
    texts = pa.chunked_array([r.column("bytes") for r in sent])
    anchors = np.concatenate([r.column("anchor").to_numpy() for r in sent])[lead]
    size = pc.binary_length(texts).to_numpy()[lead]
    order = np.argsort(anchors, kind="stable")
    flags: list[np.ndarray] = [np.zeros(0, bool)] * len(lead)
    at = 0
    while at < len(order):
        past, held = at, 0
        # Whole anchors until the segments are enough.
        while past < len(order) and (held < SORTED_BYTES or anchors[order[past]] == anchors[order[past - 1]]):
            held += size[order[past]]
            past += 1
        mine = order[at:past]
        for n, found in zip(mine, repeated(texts.take(pa.array(lead[mine])).to_pylist())):
            flags[n] = found | many[n]
        at = past
    out, done = [], 0
    for r in sent:
        own = number[done : done + r.num_rows]
        out.append(np.packbits(np.concatenate([flags[n] for n in own])).tobytes())
        done += r.num_rows
    return out


def answer_strings(data: list[bytes]) -> list[bytes]:
    """Bits of the repeated hashes of each block."""
    hashes, counts = [], []
    for d in data:
        size = int.from_bytes(d[:8], "little")
        hashes.append(unpacked_sorted(d[8 : 8 + size]))
        counts.append(unpacked_array(d[8 + size :]))
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts).astype(np.float64), len(distinct))
    return [np.packbits(f).tobytes() for f in np.split(total[place] > 1, np.cumsum([len(h) for h in hashes])[:-1])]


def finished(rows: pa.RecordBatch, answers: pa.Table, text: str, drop: tuple[str, ...]) -> pa.Table:
    """Rows of a block with FACTS: what is left without the bytes under repeated strings."""
    data, offsets = text_bytes(rows.column(text))
    found: dict[int, list[tuple[int, bytes]]] = {SEGMENTS: [], STRINGS: [], PLAN: []}
    for kind, to, bits in zip(*(answers.column(c).to_pylist() for c in ("kind", "range", "data"))):
        found[kind].append((to, bits))
    plan = unpacked_rows(found[PLAN][0][1]).column("arrays").to_pylist()
    begin, number, base, size, begin1, number1, string, size1 = (unpacked_array(a).astype(np.int64) for a in plan)
    start = [
        every(begin, number)[_bits(found[SEGMENTS], size)[every(base, number)]],
        every(begin1, number1)[_bits(found[STRINGS], size1)[string]],
    ]
    start = np.sort(np.concatenate(start))
    row = np.searchsorted(offsets, start, "right") - 1
    # Strings that overlap or touch make one span, within a text.
    fresh = np.append(True, (start[1:] > start[:-1] + LENGTH) | (row[1:] != row[:-1]))[: len(start)]
    low, high, owner = start[fresh], start[np.append(fresh[1:], True)[: len(start)]] + LENGTH, row[fresh]
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
    left = np.append(0, np.cumsum(keep))[offsets]
    pairs = pa.StructArray.from_arrays([pa.array(low - offsets[owner]), pa.array(high - offsets[owner])], ["start", "end"])
    at = np.append(0, np.cumsum(np.bincount(owner, minlength=rows.num_rows)))
    new = {
        "n_bytes": pa.array(np.diff(offsets)),
        "spans": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs),
        "kept": pa.Array.from_buffers(pa.large_binary(), rows.num_rows, [None, pa.py_buffer(left), pa.py_buffer(data[keep].tobytes())]).cast(pa.binary()),
    }
    return pa.Table.from_batches([replaced(rows, new, drop)])


def _bits(answers: list[tuple[int, bytes]], sizes: np.ndarray) -> np.ndarray:
    """Answers of all ranges in order, without the filling of their last bytes."""
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for (_, b), n in zip(sorted(answers), sizes, strict=True)]
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).astype(bool)


def without_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with FACTS in place of ``text``: bytes of the text, spans that are removed, bytes that are kept."""
    role = "role"
    while role in df.columns:
        role += "_"
    blocks = stored(pack(df.withColumn(role, F.lit(0)), text, role, LEVEL), "repeat-blocks")
    ranges = ranges_for(blocks)
    # A false match of short hashes, one item in some hundred, only sends a string that is not repeated.
    bits = min(64, (ranges * RANGE_BYTES).bit_length() + 3)
    counts = totals(blocks, lambda rows: Parsed(rows.column(text), bits).items(), ranges).filter("block >= 0").select("block", "range", "totals")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(zip(right.column("range").to_pylist(), right.column("totals").to_pylist()))
        counted = sum(joined([unpacked_array(p) for _, p in parts]))
        rows = unpacked_rows(left.column("rows")[0].as_py())
        return to_send(left.column("block")[0].as_py(), rows, text, counted, SEGMENT_RANGES * ranges, bits)

    def answer(group: pa.Table) -> pa.Table:
        data = group.column("data").to_pylist()
        bits = answer_segments(data) if group.column("kind")[0].as_py() == SEGMENTS else answer_strings(data)
        return pa.table({"kind": group.column("kind"), "range": group.column("range"), "block": group.column("block"), "data": pa.array(bits, pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return finished(unpacked_rows(left.column("rows")[0].as_py()), right, text, drop)

    drop = (text, role)
    whole = blocks.select("block", "rows").groupBy("block")
    sent = stored(whole.cogroup(counts.groupBy("block")).applyInArrow(send, SENT), "repeat-segments")
    answers = sent.filter(F.col("kind") != PLAN).groupBy("kind", "range").applyInArrow(answer, SENT)
    known = answers.unionByName(sent.filter(F.col("kind") == PLAN))
    out = stored(whole.cogroup(known.groupBy("block")).applyInArrow(finish, with_fields(df, FACTS, drop)), "repeat-free")
    deleted(df.sparkSession, blocks, sent)
    return out
