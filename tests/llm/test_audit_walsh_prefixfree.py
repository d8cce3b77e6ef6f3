"""Filter audit, Walsh-Hadamard clusters and repeated bytes against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import odd_docs, prose, same_columns
from pyspark.sql import functions as F

from fieldsurvey.llm import audit, prefixfree, walsh
from fieldsurvey.llm.queries import QUERIES, SQL
from oracle import differences, oracle_rows


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_walsh_clusters"])
def test_query_equals_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns, expected = oracle_rows(sf_dir, SQL[name])
    assert differences(df.columns, [tuple(r) for r in df.collect()], columns, expected) == []


def test_walk_visits_every_subset_once_and_holds_its_survivors():
    r = random.Random(3)
    counts = {m: (r.randint(0, 9), r.randint(0, 5), r.randint(0, 5)) for m in r.sample(range(32), 20)}
    states = audit.survivors(counts, 5)
    assert sorted(states) == list(range(32))
    for subset, state in states.items():
        assert state == tuple(sum(c[i] for m, c in counts.items() if not m & subset) for i in range(3))


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(80_000))
    texts = [
        (1, None, None), (2, "", None), (3, "plain words " * 40, "b"), (3, "plain words " * 40, "b"), (4, "plain words " * 40, "b"),
        (None, "plain words " * 40, "b"), (5, "COST $5", ""), (6, long, "b"),
    ]
    docs = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, source string, mask int, part string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {(r.part, r.filter_order, r.step): r for r in audit.audit(docs, labels).collect()}
    assert {k[0] for k in rows} == {"", "b"} and len(rows) == 2 * 120 * 5
    # NULL and empty texts are equal, and a NULL source is the empty one.
    first = rows["", "EABCD", 1]
    assert (first.kept, first.removed, first.unique_fails) == (2, 1, 0)
    # Both rows with the smallest id stay, and so does the row without an id.
    first = rows["b", "EABCD", 1]
    assert (first.kept, first.removed, first.good_lost, first.toxic_lost) == (4, 1, 0, 1)
    second = rows["b", "EBACD", 2]
    assert (second.kept, second.removed, second.redundant, second.good_lost, second.toxic_lost) == (1, 3, 1, 2, 2)
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_progressive_search_is_exact_and_leaves_differences_out():
    r = np.random.default_rng(5)
    order = walsh.fine_order(64)
    smooth = np.cumsum(r.integers(-40, 41, (400, 64)), axis=1)
    for values in (smooth, r.integers(-60, 61, (300, 64)), np.zeros((5, 64), np.int64)):
        centres = np.concatenate([values[:12], values[:4]])
        found, distance, taken = walsh.nearest(walsh.transform(values, order), walsh.transform(centres, order))
        every = ((values[:, None] - centres[None]) ** 2).sum(2)
        # The first of equal centroids.
        assert (found == every.argmin(1)).all() and (distance == every.min(1)).all()
        if values is smooth:
            assert taken < every.size * 64 / 2


def test_components_of_any_size():
    order = walsh.fine_order(64)
    values = np.array([[2**28 + i * j for j in range(64)] for i in range(6)], dtype=object)
    assert walsh.whole(values.astype(float) / 64, 64).dtype == object
    found, distance, _ = walsh.nearest(walsh.transform(values, order), walsh.transform(values[[1, 4]], order))
    every = [[sum((int(x) - int(y)) ** 2 for x, y in zip(v, values[c])) for c in (1, 4)] for v in values]
    assert [int(d) for d in distance] == [min(e) for e in every] and found.tolist() == [e.index(min(e)) for e in every]


def test_clusters_of_odd_rows(spark):
    r = random.Random(2)
    vector = lambda: [r.uniform(-1, 1) for _ in range(64)]
    same = vector()
    rows = [
        (1, same), (1, same), (2, same), (3, vector()), (None, vector()), (4, None), (5, same[:63]), (6, [*same[:63], None]),
        (7, [*same[:63], float("nan")]), (8, [*same[:63], float("inf")]), (9, []),
    ]
    df = spark.createDataFrame([(*x, 9, "x", 1) for x in rows], "vec_id long, embedding array<double>, cluster int, inertia string, n int")
    out = walsh.cluster(df)
    same_columns(df.drop("embedding", "cluster", "inertia"), out, "cluster", "distance", "cluster_inertia", "inertia", "centroid")
    got = out.collect()
    assert len(got) == 5 and all(g.distance == 0 for g in got) and len({g.cluster for g in got if g.vec_id in (1, 2)}) == 1
    assert walsh.cluster(df.limit(0)).count() == 0 and walsh.cluster(df.filter("vec_id > 3")).count() == 0
    short = walsh.cluster(df.select("vec_id", F.slice("embedding", 1, 3).alias("embedding")), k=2, dims=3).collect()
    assert len(short) == 11 - 2 and len({g.inertia for g in short}) == 1
    far = spark.createDataFrame([(1, [0.0] * 64), (2, [1e18] * 64), (3, [1e18] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        walsh.cluster(far, k=1).count()
    assert {(r.distance, int(r.centroid[5])) for r in walsh.cluster(far, k=3).collect()} == {(0, 0), (0, 64 * 10**18)}


def brute_repeats(texts, length):
    """Kept bytes and removed spans of each text."""
    texts = [(t or "").encode() for t in texts]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = [list(g) for k, g in itertools.groupby(range(len(t)), lambda i: gone[i]) if k]
        out.append((bytes(b for b, g in zip(t, gone) if not g), [(g[0], g[-1] + 1) for g in runs]))
    return out


def local_repeats(texts, blocks=3, ranges=5, bits=64):
    """The steps of the operator on a few blocks, without an engine."""
    sizes = [len(p) for p in np.array_split(np.arange(len(texts)), blocks)]
    batches, at = [], 0
    for n in sizes:
        batches.append(pa.RecordBatch.from_arrays([pa.array(texts[at : at + n], pa.string())], ["text"]))
        at += n
    parsed = [prefixfree.Parsed(b.column("text"), bits).items()[0] for b in batches]
    count = {}
    for hashes, counts in parsed:
        for h, c in zip(hashes.tolist(), counts.tolist()):
            count[h] = count.get(h, 0) + c
    sent = [
        prefixfree.to_send(n, b, "text", np.array([count[h] for h in items[0].tolist()], np.int64), ranges, bits).to_pylist()
        for n, (b, items) in enumerate(zip(batches, parsed))
    ]
    answers = [[r for r in rows if r["kind"] == prefixfree.PLAN] for rows in sent]
    for kind, answer in ((prefixfree.SEGMENTS, prefixfree.answer_segments), (prefixfree.STRINGS, prefixfree.answer_strings)):
        for to in range(ranges):
            group = [r for rows in sent for r in rows if (r["kind"], r["range"]) == (kind, to)]
            for r, bits_ in zip(group, answer([r["data"] for r in group]) if group else []):
                answers[r["block"]].append(r | {"data": bits_})
    out = []
    for batch, rows in zip(batches, answers):
        done = prefixfree.finished(batch, pa.Table.from_pylist(rows), "text", ("text",)).to_pylist()
        out += [(r["kept"], [(s["start"], s["end"]) for s in r["spans"]]) for r in done]
    return out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("common", [0, 3, 1_000])
def test_repeated_strings_against_brute_force(monkeypatch, seed, common):
    monkeypatch.setattr(prefixfree, "COMMON", common)
    monkeypatch.setattr(prefixfree, "EVERY", (4, 8, 1)[seed % 3])
    monkeypatch.setattr(prefixfree, "WINDOW", (3, 5)[seed % 2])
    monkeypatch.setattr(prefixfree, "ITEM", (8, 20)[seed % 2])
    monkeypatch.setattr(prefixfree, "LENGTH", 60)
    monkeypatch.setattr(prefixfree, "SORTED_BYTES", (500, 1 << 20)[seed % 2])
    r = random.Random(seed)
    letters = ["ab", "abcdefgh ", "aé😀\0 "][seed % 3]
    pool = ["".join(r.choice(letters) for _ in range(r.randint(20, 200))) for _ in range(6)]
    pool += ["a" * 90, "ab" * 60, "abc" * 50, pool[0], "", None]
    texts = []
    for _ in range(30):
        parts = [r.choice(pool) or "" for _ in range(r.randint(0, 4))]
        texts.append("".join(p if r.random() < 0.7 else p[: r.randint(0, 60)] + r.choice(letters) + p[r.randint(0, 60) :] for p in parts))
    texts += [texts[3], texts[3], None, "", pool[0] + pool[1], pool[1][5:] + pool[0]]
    assert local_repeats(texts, bits=(64, 12)[seed % 2]) == brute_repeats(texts, 60)


def test_long_text_of_one_character_and_long_copies():
    texts = ["x" * 100_000, prose(1, 9_000), prose(1, 9_000) + "tail", "y" * 399, "y" * 400]
    got = local_repeats(texts)
    assert got[0] == (b"", [(0, 100_000)]) and got[1][0] == b"" and got[2][0] == b"tail"
    assert got[3:] == [(b"y" * 399, []), (b"y" * 400, [])]


def test_repeats_of_the_whole_table(spark):
    found = QUERIES["op13_repeated_bytes"](spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    expected = {r.doc_id: (len((r.text or "").encode()), k, s) for r, (k, s) in zip(rows, brute_repeats([r.text for r in rows], 400))}
    assert len(found) == len(rows) and sum(r.n_removed for r in found) > 0
    for r in found:
        n, kept, spans = expected[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def test_repeats_of_odd_rows(spark):
    df = odd_docs(spark).withColumn("spans", F.lit("x")).withColumn("x.y", F.lit(1)).withColumn("role_", F.lit(2))
    out = prefixfree.without_repeats(df)
    same_columns(df.drop("text"), out, "n_bytes", "spans", "kept")
    texts = [r.text for r in df.collect()]
    kept = {(r.n): (bytes(r.kept), [tuple(s) for s in r.spans]) for r in out.collect()}
    assert [kept[n][0] for n in range(len(texts))] == [b"" if n == 5 else (t or "").encode() for n, t in enumerate(texts)]
    assert kept[5][1] == [(0, 8 * 30_000)]
    assert prefixfree.without_repeats(df.limit(0)).count() == 0
