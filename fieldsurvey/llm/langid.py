"""Language of texts and of spans inside them.

A word (a run of letters) is scored in every language by its byte trigrams and as a
whole, counted in a fixed number of hashed cells over all training texts. The script of
its first letter narrows the languages to those that use this script. Viterbi's
recursion, with a penalty for each change of language, then labels the words of a text;
words of one label in a row are a span. Texts of a batch run side by side, one word of
each in a step, and memory is one byte for each word and language.

Defined results: a text that is NULL or has no letter is ``und`` with score 0 and
without spans; without any training text everything is ``und``; a script that no
training text has leaves all languages open; of equally good languages the first by
name wins; repeated rows get equal results and count each when learning; other columns
pass through, those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsurvey.llm.arrow import Tokens, mixed, replaced, slices, text_bytes, with_fields
from fieldsurvey.llm.sums import SCHEMA, emitted, summed, whole

CELLS = 1 << 15
#: The model has CELLS numbers for each language and is sent to every task.
MAX_LANGUAGES = 255
#: Loss of log-probability for each change of language inside a text.
SWITCH = 12.0
UNKNOWN = "und"
#: Part of a language's words that a script must have to count as its script.
SCRIPT_SHARE = 0.01
#: First code points of the ranges of scripts, and their names.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x323B0, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


def letter_classes() -> np.ndarray:
    """Letters of ASCII and all bytes beyond it."""
    table = np.zeros(256, np.uint8)
    table[65:91] = table[97:123] = 1
    table[128:] = 1
    return table


def scripts_of(words: list[bytes]) -> np.ndarray:
    """Number of the script of the first character of each word."""
    first = np.fromiter((ord(w[:4].decode("utf-8", "ignore")[:1] or "\0") for w in words), np.int64, len(words))
    of_range = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
    return of_range[np.searchsorted(np.array([low for low, _ in SCRIPTS]), first, "right") - 1]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all features of all words, and the first feature of each word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    data = np.frombuffer(b"^" + b"$^".join(words) + b"$\0", np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(length + 2) - length - 2
    # One trigram centred on each byte of a word, then the word as a whole.
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length) + 1
    grams = (data[at - 1] << np.uint64(16)) | (data[at] << np.uint64(8)) | data[at + 1]
    first = np.cumsum(length + 1) - length - 1
    out = np.empty(int((length + 1).sum()), np.uint64)
    inside = np.ones(len(out), bool)
    inside[first + length] = False
    out[inside] = grams
    out[~inside] = np.fromiter((hash_word(w) for w in words), np.uint64, len(words))
    return (mixed(out) % np.uint64(CELLS)).astype(np.int64), np.append(first, len(out))


def hash_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) | 1 << 63


@dataclass
class Languages:
    """Log-probability of each cell in each language, and which scripts each language has."""

    names: list[str]
    cells: np.ndarray
    uses: np.ndarray


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Counts over all rows of ``df`` with a language."""
    known = df.filter(F.col(lang).isNotNull()).select(text, lang)
    scripts = len(SCRIPT_NAMES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, text):
                tokens = Tokens(part.column(text), letter_classes())
                cell, first = features(tokens.values)
                each, script = np.diff(first), scripts_of(tokens.values)
                names, code = np.unique(np.array(part.column(lang).to_pylist(), object).astype(str), return_inverse=True)
                of_token = code[tokens.row]
                for i, name in enumerate(names.tolist()):
                    n = np.bincount(tokens.code[of_token == i], minlength=len(tokens.values)).astype(float)
                    total = counts.setdefault(name, np.zeros(CELLS + scripts))
                    total[:CELLS] += np.bincount(cell, np.repeat(n, each), CELLS)
                    total[CELLS:] += np.bincount(script, n, scripts)
                if len(counts) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
        yield from emitted(counts)

    found = summed(known.mapInArrow(task, SCHEMA))
    names = sorted(found)
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.array([whole(found[n], CELLS + scripts) for n in names]).reshape(len(names), CELLS + scripts).T
    counts, words = table[:CELLS] + 0.1, table[CELLS:]
    uses = words >= SCRIPT_SHARE * np.maximum(words.sum(0), 1)
    uses[~uses.any(1)] = True
    return Languages(names, np.log(counts / counts.sum(0)).astype(np.float32), uses)


def word_scores(words: list[bytes], model: Languages) -> np.ndarray:
    """Log-probability of each word in each language; languages without its script are out."""
    cell, first = features(words)
    out = np.empty((len(words), len(model.names)), np.float32)
    for low in range(0, len(words), 1 << 15):
        high = min(low + (1 << 15), len(words))
        values = model.cells[cell[first[low] : first[high]]]
        out[low:high] = np.add.reduceat(values, first[low:high] - first[low], axis=0)
    out[~model.uses[scripts_of(words)]] = -1e6
    return out


def viterbi(scores: np.ndarray, code: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every token; ``first`` has the first token of each text and the end."""
    languages = scores.shape[1]
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    # Texts that still have a word at each step: a part of `order` from its start.
    active = np.searchsorted(-size, -np.arange(longest), "left")
    came = np.empty((len(code), languages), np.uint8)
    best = np.zeros((len(order), languages), np.float32)
    own = np.arange(languages, dtype=np.uint8)
    for step in range(longest):
        at = begin[: active[step]] + step
        here = best[: active[step]]
        top = here.argmax(1)
        jump = np.take_along_axis(here, top[:, None], 1) - penalty
        stay = here >= jump
        came[at] = np.where(stay, own, top[:, None])
        best[: active[step]] = np.where(stay, here, jump) + scores[code[at]]
    label = np.empty(len(code), np.uint8)
    state = best.argmax(1)
    for step in range(longest - 1, -1, -1):
        at = begin[: active[step]] + step
        now = state[: active[step]]
        label[at] = now
        state[: active[step]] = came[at, now]
    return label


def identify(df: DataFrame, model: Languages, text: str = "text", out: str = "lang_pred", score: str = "score", spans: str = "lang_spans", penalty: float = SWITCH) -> DataFrame:
    """``df`` with the main language, its share of all letters, and the spans of each language.

    Spans are start and end (code points, end exclusive) of the first and last word, and the language.
    """
    shared = df.sparkSession.sparkContext.broadcast(vars(model))
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    fields = [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(spans, span_type)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(**shared.value)
        for batch in batches:
            for part in slices(batch, text):
                yield replaced(part, labelled(part.column(text), languages))

    def labelled(column: pa.Array, languages: Languages) -> dict[str, pa.Array]:
        tokens = Tokens(column, letter_classes())
        names, rows = languages.names, tokens.rows
        if not names or not len(tokens.code):
            label, share, found = np.full(rows, -1), np.zeros(rows), ([], [], [], np.zeros(rows + 1, np.int64))
        else:
            label_of = viterbi(word_scores(tokens.values, languages), tokens.code, tokens.first, penalty)
            data, _ = text_bytes(column)
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            letters = points[tokens.end] - points[tokens.start]
            mass = np.bincount(tokens.row * len(names) + label_of, letters, rows * len(names)).reshape(rows, -1)
            label = np.where(mass.sum(1) > 0, mass.argmax(1), -1)
            share = mass.max(1) / np.maximum(mass.sum(1), 1)
            cut = np.flatnonzero(np.append(True, (tokens.row[1:] != tokens.row[:-1]) | (label_of[1:] != label_of[:-1])))
            last = np.append(cut[1:], len(label_of)) - 1
            base = points[tokens.offsets[tokens.row[cut]]]
            found = (points[tokens.start[cut]] - base, points[tokens.end[last]] - base, label_of[cut], np.searchsorted(tokens.row[cut], np.arange(rows + 1)))
        begins, ends, which, offsets = found
        structs = pa.StructArray.from_arrays(
            [pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array([names[i] for i in which], pa.string())], ["start", "end", "lang"]
        )
        return {
            out: pa.array([names[i] if i >= 0 else UNKNOWN for i in label], pa.string()),
            score: pa.array(share.astype(np.float64)),
            spans: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
        }

    found = df.mapInArrow(task, with_fields(df, fields))
    # Bytes beyond ASCII may be signs; whether there is any letter is asked of the characters.
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return found.withColumns({
        out: F.when(has_letter, F.col(out)).otherwise(UNKNOWN),
        score: F.when(has_letter, F.col(score)).otherwise(0.0),
        spans: F.when(has_letter, F.col(spans)).otherwise(F.array().cast(span_type)),
    })
