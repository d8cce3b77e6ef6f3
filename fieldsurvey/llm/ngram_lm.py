"""Log-probability of texts under bigrams mixed by deleted interpolation.

A text is its words and one end. The probability of a token after its context (the
token before, or the begin of the text) is a mixture of the maximum-likelihood estimates
of bigram and unigram and of a uniform share for unknown tokens. The weights depend on
how often the context was counted, in buckets of powers of two. They are learned by
expectation-maximisation on a part of the training texts (``DEVELOP`` of all hashes)
under counts from which that part is deleted; the scores use the counts of all training
texts. All counts cover all training texts and grow with them; see ``blocks`` for how
they are counted and brought back. The held-out events meet as a table of fixed size:
bucket and logarithmic steps of both estimates.

Words and bigrams are held as hashes of 64 and 56 bits.

Defined results: NULL is the empty text, which has one token; repeated rows count each
time; without training texts every token is unknown and both scores are 0; without
events for a bucket the weights of the bucket below hold; other columns pass through,
those named like an output are replaced; a very long text is a block of its own; an empty table gives an empty table.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsurvey.llm.arrow import Tokens, chained, hash_values, replaced, with_fields, word_classes
from fieldsurvey.llm.blocks import Items, deleted, joined, pack, ranges_for, stored, totals, with_totals
from fieldsurvey.llm.columns import unused
from fieldsurvey.llm.sums import SCHEMA, emitted, summed, whole

#: Part of the training texts whose events teach the weights: one of so many.
DEVELOP = 7
BUCKETS, STEPS, STEP = 24, 64, 0.2
WORDS, PAIRS = 0, 1
#: No word holds white space, so these stand for end and begin.
END, BEGIN = hash_values([b" "])[0], hash_values([b"  "])[0]
START_WEIGHTS = (0.3, 0.6, 0.1)


class Events:
    """Tokens of a block, their contexts, and the distinct hashes of words and bigrams."""

    def __init__(self, column: pa.Array):
        tokens = Tokens(column, word_classes())
        rows = tokens.rows
        self.row = np.repeat(np.arange(rows), np.diff(tokens.first) + 1)
        ends = np.cumsum(np.diff(tokens.first) + 1) - 1
        word = np.full(len(self.row), END, np.uint64)
        inner = np.ones(len(self.row), bool)
        inner[ends] = False
        word[inner] = tokens.hashes()
        before = np.append(BEGIN, word[:-1]).astype(np.uint64)
        before[np.append(0, ends[:-1] + 1) if rows else ends] = BEGIN
        pair = chained([before, word]) & ~np.uint64(0xFF)
        self.words, self.word, self.word_counts = np.unique(word, return_inverse=True, return_counts=True)
        self.pairs, self.pair, self.pair_counts = np.unique(pair, return_inverse=True, return_counts=True)
        # Places in the distinct hashes fit four bytes: a block holds some megabytes of text.
        self.word, self.pair = self.word.astype(np.int32), self.pair.astype(np.int32)
        self.rows = rows
        # The context as a word of this block; a begin has its own count.
        self.context = np.append(-1, self.word[:-1]) if rows else self.word
        if rows:
            self.context[np.append(0, ends[:-1] + 1)] = -1

    def items(self) -> Items:
        return {WORDS: (self.words, self.word_counts), PAIRS: (self.pairs, self.pair_counts)}

    def estimates(self, words: np.ndarray, pairs: np.ndarray, mass: float) -> tuple[np.ndarray, ...]:
        """Bucket of the context, bigram and unigram estimates of each token."""
        # A begin is counted as often as an end: each text has one of both.
        end = words[np.searchsorted(self.words, END)] if self.rows else 0
        context = np.where(self.context < 0, end, words[self.context])
        bucket = np.minimum(np.floor(np.log2(context + 1.0)), BUCKETS - 1).astype(np.int64)
        return bucket, pairs[self.pair] / np.maximum(context, 1), words[self.word] / max(mass, 1)


def step_of(f: np.ndarray) -> np.ndarray:
    """0 for no estimate, else the logarithmic step."""
    with np.errstate(divide="ignore"):
        return np.where(f > 0, np.clip(1 + np.floor(-np.log10(f) / STEP), 1, STEPS - 1), 0).astype(np.int64)


def mixture(cells: np.ndarray, unknown: float, rounds: int = 200) -> np.ndarray:
    """Weights of bigram, unigram and uniform share for each bucket, by expectation-maximisation."""
    at = np.arange(STEPS)
    value = np.where(at > 0, 10.0 ** (-(at - 0.5) * STEP), 0.0)
    weights = np.tile(START_WEIGHTS, (BUCKETS, 1))
    weights[0] = (0, 0.7, 0.3)
    cells = cells.reshape(BUCKETS, STEPS, STEPS)
    for bucket in range(BUCKETS):
        two, one = np.nonzero(cells[bucket])
        if not len(two):
            weights[bucket] = weights[bucket - 1] if bucket > 1 else weights[bucket]
            continue
        n = cells[bucket][two, one]
        f = np.stack([value[two], value[one], np.full(len(n), unknown)], 1)
        w = np.array(START_WEIGHTS)
        for _ in range(rounds):
            part = w * f
            part /= part.sum(1, keepdims=True)
            # A little is left to each term, so that no token becomes impossible.
            w = (n @ part + 1e-3) / (n.sum() + 3e-3)
        weights[bucket] = w
    return weights


def score(df: DataFrame, training: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` without text, with ``n_tokens, n_known, train_tokens, base_score, score``.

    Rows with ``training`` are learned from; ``key`` decides which of them are the held-out part.
    """
    part = F.pmod(F.xxhash64(F.lit("develop"), F.col(key)), F.lit(DEVELOP)) == 0
    role = F.when(~F.coalesce(training, F.lit(False)), 2).when(part, 1).otherwise(0).cast("int")
    named = unused(df, "__role")
    blocks = stored(pack(df.withColumn(named, role), text, named), "lm-blocks")
    items = lambda rows: Events(rows.column(text)).items()
    answers = stored(totals(blocks, items, ranges_for(blocks)), "lm-counts")
    words = answers.filter(f"block < 0 AND kind = {WORDS}").agg(F.sum("distinct"), F.sum("mass0"), F.sum("mass1")).first()
    distinct, mass, held = (int(x or 0) for x in words)
    unknown = 1 / (distinct + 1)
    weights = mixture(_held_out_events(blocks, answers, text, mass), unknown)
    scored = stored(_scored(df, blocks, answers, (text, named), weights, distinct, mass + held, unknown), "lm-scores")
    deleted(df.sparkSession, blocks, answers)
    return scored


def _held_out_events(blocks: DataFrame, answers: DataFrame, text: str, mass: int) -> np.ndarray:
    def task(rows: pa.RecordBatch, found: dict[int, list[np.ndarray]]) -> pa.Table:
        events = Events(rows.column(text))
        main = {k: joined(v)[0] for k, v in found.items()}
        bucket, two, one = events.estimates(main[WORDS], main[PAIRS], mass)
        cell = (bucket * STEPS + step_of(two)) * STEPS + step_of(one)
        sums = np.bincount(cell, minlength=BUCKETS * STEPS * STEPS).astype(float)
        return pa.Table.from_batches(list(emitted({"events": sums})))

    held = blocks.filter("role = 1")
    own = answers.join(held.select("block"), "block", "left_semi")
    cells = summed(with_totals(held, own, task, SCHEMA))
    return whole(cells.get("events"), BUCKETS * STEPS * STEPS)


def _scored(df: DataFrame, blocks: DataFrame, answers: DataFrame, drop: tuple[str, str], weights: np.ndarray, distinct: int, mass: int, unknown: float) -> DataFrame:
    fields = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
    fields += [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]

    def task(rows: pa.RecordBatch, found: dict[int, list[np.ndarray]]) -> pa.Table:
        events = Events(rows.column(drop[0]))
        all_ = {k: sum(joined(v)) for k, v in found.items()}
        bucket, two, one = events.estimates(all_[WORDS], all_[PAIRS], mass)
        count = all_[WORDS][events.word]
        two *= weights[bucket, 0]
        one *= weights[bucket, 1]
        chance = two + one + weights[bucket, 2] * unknown
        base = np.log10((count + 1) / (mass + distinct + 1))
        sums = lambda x: np.bincount(events.row, x, rows.num_rows)
        out = {
            "n_tokens": pa.array(sums(None).astype(np.int64)), "n_known": pa.array(sums(count > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(rows.num_rows, mass, np.int64)), "base_score": pa.array(sums(base)),
            "score": pa.array(sums(np.log10(chance)) if mass else np.zeros(rows.num_rows)),
        }
        return pa.Table.from_batches([replaced(rows, out, drop)])

    return with_totals(blocks, answers, task, with_fields(df, fields, drop))
