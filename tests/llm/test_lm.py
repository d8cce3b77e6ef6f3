"""Interpolated language model against a direct computation."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import odd_docs, same_columns, words
from pyspark.sql import functions as F

from fieldsurvey.llm import blocks, ngram_lm
from fieldsurvey.llm.queries import QUERIES


def brute(rows, training, weights, unknown=None):
    """Base score and score of each text under given weights."""
    tokens = lambda t: [*words(t), " "]
    used = [tokens(t) for t, learn in zip(rows, training) if learn]
    one, two = Counter(w for t in used for w in t), Counter(p for t in used for p in zip(["  ", *t], t))
    one["  "] = 0
    mass, distinct = sum(one.values()), sum(v > 0 for v in one.values())
    out = []
    for text in rows:
        own = tokens(text)
        base = score = 0.0
        for before, word in zip(["  ", *own], own):
            context = one[" "] if before == "  " else one[before]
            w = weights[min(int(math.log2(context + 1)), ngram_lm.BUCKETS - 1)]
            chance = w[0] * two[before, word] / max(context, 1) + w[1] * one[word] / max(mass, 1) + w[2] / (distinct + 1)
            base += math.log10((one[word] + 1) / (mass + distinct + 1))
            score += math.log10(chance) if mass else 0.0
        out.append((len(own), sum(one[w] > 0 for w in own), mass, base, score))
    return out


def test_counts_base_and_score_against_brute_force(spark, sf_dir, monkeypatch):
    weights = []
    mixture = ngram_lm.mixture
    monkeypatch.setattr(ngram_lm, "mixture", lambda cells, unknown: weights.append(mixture(cells, unknown)) or weights[-1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = {r.doc_id: r for r in QUERIES["op3_interpolated_lm"](spark, sf_dir).collect()}
    held = [zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs]
    for r, h, (n, known, mass, base, score) in zip(docs, held, brute([r.text for r in docs], [not h for h in held], weights[0])):
        g = found[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (h, n, known, mass)
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.score == pytest.approx(score, rel=1e-9)
    mine = [g for g in found.values() if g.held_out]
    assert sum(g.score for g in mine) > sum(g.base_score for g in mine)
    assert all(w.sum() == pytest.approx(1) and (w >= 0).all() for w in weights[0])


def test_weights_follow_the_held_out_events():
    cells = np.zeros((ngram_lm.BUCKETS, ngram_lm.STEPS, ngram_lm.STEPS))
    cells[3, 1, 20] = 100  # the bigram is nearly certain
    cells[5, 0, 5] = 100  # never seen after this context
    cells[7, 0, 0] = 100  # unknown tokens
    w = ngram_lm.mixture(cells.ravel(), 1e-6)
    assert w[3, 0] > 0.99 and w[5, 1] > 0.99 and w[7, 2] > 0.99
    assert (w[4] == w[3]).all()


def test_odd_rows(spark):
    df = odd_docs(spark)
    out = ngram_lm.score(df, F.col("n") != 5)
    same_columns(df.drop("text"), out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    found = {r.n: r for r in out.collect()}
    assert [found[n].n_tokens for n in (0, 1, 2, 3, 5, 6)] == [1, 1, 1, 3, 60_001, 7]
    assert found[6].score == found[7].score
    assert found[5].n_known == 1 and found[0].n_known == 1
    assert ngram_lm.score(df.limit(0), F.lit(True)).count() == 0
    alone = ngram_lm.score(df, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in alone} == {(0, 0, 0.0, 0.0)}


def test_small_blocks_and_ranges_change_nothing(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 200").select("doc_id", "text")
    plain = {r.doc_id: r for r in ngram_lm.score(docs, F.col("doc_id") % 3 > 0).collect()}
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(blocks, "RANGE_BYTES", 5_000)
    for r in ngram_lm.score(docs.repartition(5), F.col("doc_id") % 3 > 0).collect():
        p = plain[r.doc_id]
        assert r[:4] == p[:4] and r.base_score == pytest.approx(p.base_score) and r.score == pytest.approx(p.score)


def test_packing_of_whole_numbers():
    for values in ([], [0], [1, 255, 256, 2**63], list(range(1000))):
        a = np.array(values, np.uint64)
        assert (blocks.unpacked_array(blocks.packed_array(a)) == a).all()
        assert (blocks.unpacked_sorted(blocks.packed_sorted(a)) == a).all()
