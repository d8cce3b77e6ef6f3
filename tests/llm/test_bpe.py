"""Byte-level BPE against the library that the ranks were made for."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import ODD_TEXTS, odd_docs, same_columns

from fieldsurvey.llm import bpe
from fieldsurvey.llm.queries import QUERIES, RANKS


@pytest.fixture(scope="module")
def library():
    lines = open(RANKS, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def encoded(encoder, texts):
    return encoder.finish([encoder.numbers(t) for t in texts]).to_pylist()


def test_every_basic_character(encoder, library):
    texts = [chr(i) * 3 + " " + chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    assert encoded(encoder, texts) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("letters", ["ab", "aaab ", "thenigra ", "0123 .,=-'s\n", "日本語テa"])
def test_random_texts(encoder, library, letters):
    r = random.Random(letters)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 300))) for _ in range(200)]
    assert encoded(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_merge_that_makes_an_earlier_one_possible():
    """Here `bc` has a later rank than `abc`, which can only follow it."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"cd"]
    table = bpe.MergeTable(tokens)
    ids, counts = bpe.replay([b"abcd", b"bcabc", b"zabcabcabcd"], table)
    library = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    expected = [library.encode_ordinary(w) for w in ("abcd", "bcabc", "zabcabcabcd")]
    assert ids.tolist() == sum(expected, []) and counts.tolist() == [len(e) for e in expected]


@pytest.mark.parametrize("seed", range(12))
def test_vocabularies_in_any_order(seed):
    """Ranks that no training would give: a merge often makes one of a lower rank possible, also within a run."""
    r = random.Random(seed)
    letters = "ab" if seed % 2 else "abcd"
    tokens = list({"".join(r.choice(letters) for _ in range(r.randint(2, 5))).encode() for _ in range(60)})
    tokens += [bytes([b]) for b in range(256)]
    r.shuffle(tokens)
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(500)]
    library = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    ids, counts = bpe.replay([w.encode() for w in words], bpe.MergeTable(tokens))
    ends = counts.cumsum()
    found = [ids[e - c : e].tolist() for e, c in zip(ends, counts)]
    assert found == [library.encode_ordinary(w) for w in words]


def test_query_encodes_the_whole_table_as_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows_and_round_trip(spark, library):
    df = odd_docs(spark)
    coded = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    at_once = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded="decoded", keep_text=False)
    assert "text" not in at_once.columns and at_once.exceptAll(coded.drop("text")).isEmpty()
    same_columns(df, coded, "ids", "decoded")
    rows = sorted(coded.collect(), key=lambda r: r.n)
    for r, (_, text) in zip(rows, ODD_TEXTS):
        assert r.ids == library.encode_ordinary(text or "") and bytes(r.decoded) == (text or "").encode()


def test_clashing_names_empty_tables_and_missing_ids(spark):
    df = spark.createDataFrame([("a b", 1, "x")], "text string, ids int, decoded string")
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert out.columns == ["text", "ids", "decoded"] and bytes(out.first().decoded) == b"a b"
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([(None,), ([64, None, 65],), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(ids, RANKS).collect()] == [b"", bpe.read_ranks(RANKS)[64] + bpe.read_ranks(RANKS)[65], b""]
    with pytest.raises(Exception):
        bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>"), RANKS).collect()


def test_blocks_do_not_change_ids(spark, monkeypatch, encoder, library):
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 7)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    texts = [f"word{i % 7} and more {i}" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(2)
    found = {r.n: r.ids for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert found == {n: library.encode_ordinary(t) for n, t in enumerate(texts)}
