"""Top-k search, Jaccard classes, benchmark leaks and the pipeline."""

import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD_TEXTS, odd_docs, prose, same_columns, shingles
from pyspark.sql import functions as F

import corpus_pipeline
from fieldsurvey.llm import blocks, jaccard, leaks, secrets, topk
from fieldsurvey.llm.graph import components
from fieldsurvey.llm.queries import QUERIES


@pytest.mark.parametrize("size, spread", [(4, 3), (16, 20), (16, 3000), (8, 10**8)])
def test_search_against_all_scores(size, spread):
    r = np.random.default_rng(size)
    values = r.integers(-spread, spread + 1, (9000, size))
    values[3000:3600] = values[3000]
    values[:50] *= 3
    ids = r.permutation(9000)
    order = np.argsort(ids)
    values, ids = values[order], ids[order]
    asks = np.arange(0, 9000, 300)
    query, ident, score = topk.search(values[asks], ids[asks], values, ids, 20)
    all_scores = values[asks] @ values.T
    for n, q in enumerate(asks):
        others = np.flatnonzero(ids != ids[q])
        best = others[np.lexsort((ids[others], -all_scores[n, others]))[:20]]
        assert (ident[query == n] == ids[best]).all() and (score[query == n] == all_scores[n, best]).all()


@pytest.mark.parametrize("copies", [2, 21, 50, 81, 4090])
def test_search_with_many_rows_of_the_query_id(copies):
    """Rows with the query's own id, better than all others, in one block."""
    values = np.random.default_rng(copies).integers(0, 10, (4096, 1))
    ids = np.arange(4096) + 1
    values[:copies], ids[:copies] = 10, 0
    query, ident, score = topk.search(values[:1], ids[:1], values, ids, 20)
    best = copies + np.lexsort((ids[copies:], -values[copies:, 0]))[:20]
    assert ident.tolist() == ids[best].tolist() and score.tolist() == (10 * values[best, 0]).tolist()


def test_top_k_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 3)
    monkeypatch.setattr(topk, "QUERIES", 1)
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (1, [3.0, -1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 0.0]), (6, [1.0]), (7, []), (8, []), (20, [0.5, 0.5]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", topk.scaled(F.col("embedding")))
    found = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id").isin(0, 1, 7, 20), k=2).collect())
    dot = lambda a, b: sum(int(64 * x) * int(64 * y) for x, y in zip(a, b))
    assert found == [
        (0, 1, 20, dot([1, 2], [0.5, 0.5])), (0, 2, 1, dot([1, 2], [3, -1])), (1, 1, 0, dot([3, -1], [1, 2])), (1, 2, 20, dot([3, -1], [0.5, 0.5])),
        (7, 1, 8, 0), (20, 1, 0, dot([1, 2], [0.5, 0.5])), (20, 2, 1, dot([3, -1], [0.5, 0.5])),
    ]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def brute_classes(rows):
    """Smallest id of each row's component, over all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    for i, j in {(i, j) for own in lists.values() for i in own for j in own if i < j}:
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            up[root(j)] = root(i)
    least = defaultdict(lambda: None)
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[root(i)] = ident if least[root(i)] is None else min(ident, least[root(i)])
    return [(ident, len(s), least[root(i)] if s else ident) for i, ((ident, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed, copies, length, rate):
    """Copies of one text with words changed, removed and added, some of them copies of copies."""
    r = random.Random(seed)
    made = [prose(seed, length).split()]
    for _ in range(copies):
        own = list(r.choice(made[:5]))
        for _ in range(r.randint(0, int(length * rate))):
            at = r.randrange(len(own))
            own[at : at + 1] = r.choice([[f"w{r.randint(0, 5)}"], [], [own[at], "also"]])
        made.append(own)
    return [" ".join(m) for m in made]


@pytest.mark.parametrize("seed, length, rate", [(1, 150, 0.06), (2, 60, 0.1), (3, 12, 0.2), (4, 6, 0.5)])
def test_classes_against_all_pairs(spark, seed, length, rate):
    texts = near_copies(seed, 120, length, rate) + near_copies(seed + 50, 30, length * 2, rate / 2)
    texts += [prose(seed * 100 + n, length) for n in range(20)] + texts[:10] + [t.upper() + " \n" for t in texts[:5]]
    rows = list(enumerate(random.Random(seed).sample(texts, len(texts)), 100)) + ODD_TEXTS
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = [tuple(r) for r in jaccard.classes(df).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute_classes(rows)))


def test_classes_of_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = [tuple(r) for r in QUERIES["op9_jaccard_join"](spark, sf_dir).collect()]
    assert sorted(found) == sorted(brute_classes(rows))


def test_classes_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 100)
    df = odd_docs(spark)
    assert sorted(map(repr, map(tuple, jaccard.classes(df).collect()))) == sorted(map(repr, brute_classes(ODD_TEXTS)))
    assert jaccard.classes(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, n) for n in range(101, 140)] + [(201, 200), (201, 201)]
    found = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {found[n] for n in range(41)} == {0} and {found[n] for n in range(100, 140)} == {100} and found[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")


def test_leaks_of_whole_table(spark, sf_dir, benchmark):
    """Every text that holds most four-word sequences of an item, and no other."""
    items = {r.item_id: leaks.Items([r.item_id], [r.text]).words[0] for r in benchmark.collect()}
    grams = {i: set(zip(w, w[1:], w[2:], w[3:])) for i, w in items.items()}
    expected = set()
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        own = leaks.Items([0], [d.text]).words
        have = set(zip(own[0], own[0][1:], own[0][2:], own[0][3:])) if own else set()
        expected |= {(d.doc_id, i) for i, g in grams.items() if len(g & have) > 0.5 * len(g)}
    rows = QUERIES["op10_benchmark_leaks"](spark, sf_dir).collect()
    assert expected and {(r.doc_id, r.item_id) for r in rows} == expected
    assert len(rows) == len(expected)


@pytest.mark.parametrize("rate, least", [(0.0, 1.0), (0.1, 0.98), (0.2, 0.9)])
def test_paraphrases_and_clean_texts(spark, benchmark, rate, least):
    r = random.Random(int(rate * 10))
    texts = {b.item_id: b.text for b in benchmark.collect()}
    carriers = [d.text for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars < 6000").limit(150).collect()]
    clean = {d[0] for d in enumerate(carriers)}
    before = {(x.doc_id, y.item_id) for x in leaks.find(spark.createDataFrame(list(enumerate(carriers)), "doc_id long, text string"), benchmark).collect() for y in x.leaks}
    rows, planted = [], set()
    for n, text in enumerate(carriers):
        item = r.choice(list(texts))
        said = [w for w in texts[item].split() for w in ([w] if r.random() > rate else r.choice([[], ["changed"], [w, "so"]]))]
        own = text.split(" ")
        at = r.randrange(len(own) + 1)
        rows.append((n, " ".join(own[:at] + said + own[at:])))
        planted.add((n, item))
    found = {(x.doc_id, y.item_id) for x in leaks.find(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect() for y in x.leaks}
    assert len(found & planted) >= least * len(planted)
    assert not found - planted - before and clean


def test_candidates_against_all_passages(spark, benchmark):
    """Recall of the search on reduced vectors against cosines of whole vectors."""
    rows = benchmark.collect()
    items = leaks.Items([r.item_id for r in rows], [r.text for r in rows])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    weight, halves = leaks._frequencies(docs, "text", items.cells)
    items.cells = items.telling(weight)
    directions = leaks._directions(docs, "text", items, weight, halves)
    import pyarrow as pa

    passages = leaks.Passages(pa.array([t.text for t in docs.collect()]), items.cells)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    full = np.zeros((passages.halves, items.size), np.float32)
    np.add.at(full, (passages.half, passages.cell), weight[passages.cell])
    exact = unit(full) @ unit(items.vectors(weight)).T
    near = {(h, i) for h, i, _ in leaks._candidates(passages, directions, items.vectors(np.ones(leaks.CELLS, np.float32)) @ directions, leaks.COSINE)}
    # Passages that hold half of an item.
    held = full @ items.vectors(weight).T / (np.linalg.norm(items.vectors(weight), axis=1) ** 2)
    wanted = list(zip(*np.nonzero((exact >= 0.6) & (held >= 0.5))))
    assert wanted and np.mean([w in near for w in wanted]) >= 0.9


def test_directions_are_fitted_on_all_texts(spark, monkeypatch):
    """More rows than the fit once took, some of them repeated."""
    seen, directions = [], leaks._directions
    monkeypatch.setattr(leaks, "_directions", lambda docs, *a: seen.append(docs.count()) or directions(docs, *a))
    item = "the quick brown fox jumps over a lazy dog near the river bank"
    df = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id") % 2000, F.when(F.col("id") == 7, " " + item).otherwise("")).alias("text"))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in leaks.find(df, items).collect() if r.leaks] == [7]
    assert seen == [2500]


def test_add_rows_against_plain_sums():
    r = np.random.default_rng(3)
    into = np.sort(np.concatenate([np.zeros(3 * leaks.RUN_ROWS, int), r.integers(0, 50, 500), np.full(leaks.PART_WORDS, 60)]))
    rows, which = r.integers(0, 9, (40, 5)).astype(float), r.integers(0, 40, len(into))
    out, expected = np.zeros((70, 5)), np.zeros((70, 5))
    leaks.add_rows(out, into, rows, which)
    np.add.at(expected, into, rows[which])
    assert (out == expected).all()


@pytest.mark.parametrize("length", [150, 300, 1000])
def test_long_items_word_for_word(spark, benchmark, length):
    """Items of many passages, whole or most of them, inside of other texts."""
    texts = [d.text for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(400).collect()]
    stock = " ".join(texts[200:]).split()
    items = {900 + n: stock[n * length : (n + 1) * length] for n in range(8)}
    both = benchmark.unionByName(spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    rows, planted = [], set()
    for n, text in enumerate(texts[:160]):
        own, item = text.split(), 900 + n % 8
        at = random.Random(n).randrange(len(own) + 1)
        # Every other text has the first 80 % only.
        said = items[item][: length if n % 2 else length * 4 // 5]
        rows.append((n, " ".join(own[:at] + said + own[at:])))
        planted.add((n, item))
    found = leaks.find(spark.createDataFrame(rows, "doc_id long, text string"), both).collect()
    assert {(x.doc_id, y.item_id) for x in found for y in x.leaks if y.item_id >= 900} >= planted


def test_short_items_word_for_word(spark, benchmark):
    """Items of one to four words, found as whole word sequences only."""
    short = spark.createDataFrame([(910, "Forty-two?"), (911, "Quokka"), (912, "who ate forty two"), (913, "forty"), (914, "forty two"), (915, "?!")], "item_id long, text string")
    texts = ["It says: forty, TWO.", "ends with forty", "two begins", "who ate forty quokkas", "the quokka", "Who ate\nforty two", None, ""]
    expected = [{910, 913, 914}, {913}, set(), {913}, {911}, {910, 912, 913, 914}, set(), set()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for items in (short, benchmark.unionByName(short)):
        found = {r.doc_id: [x.item_id for x in r.leaks] for r in leaks.find(df, items).collect()}
        assert [set(found[n]) for n in range(len(texts))] == expected
        assert all(len(set(x)) == len(x) for x in found.values())


def test_leaks_of_odd_rows(spark, benchmark, monkeypatch):
    df = odd_docs(spark).withColumn("leaks", F.lit("mine"))
    item = benchmark.first().text
    items = benchmark.unionByName(spark.createDataFrame([(900, None), (901, ""), (None, item), (902, "a b"), (903, item)], "item_id long, text string"))
    out = leaks.find(df.unionByName(df.withColumn("text", F.concat(F.lit("x "), F.lit(item)))), items)
    same_columns(df, out, "leaks")
    first = benchmark.first().item_id
    assert {tuple(x.item_id for x in r.leaks) for r in out.collect() if (r.text or "").startswith("x ")} == {(first, 903)}
    assert {len(r.leaks) for r in out.collect() if not (r.text or "").startswith("x ")} == {0}
    assert leaks.find(df.limit(0), items).count() == 0
    assert {len(r.leaks) for r in leaks.find(df, items.limit(0)).collect()} == {0}
    monkeypatch.setattr(leaks, "ROUND_ITEMS", 15)
    again = leaks.find(df.withColumn("text", F.lit("x " + item)), items)
    assert {tuple(sorted(x.item_id for x in r.leaks)) for r in again.collect()} == {(first, 903)}


def test_common_length():
    a, b = "abcbdab", "bdcaba"
    masks = leaks.masks_of([c.encode() for c in a])
    assert leaks.common_length(masks, len(a), [c.encode() for c in b]) == 4


def test_pipeline_stages(spark, sf_dir):
    """Each stage against its operator's own answer on what it was given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        made = blocks.stored(stage(spark, given, sf_dir), f"test-{name}")
        before = {r.doc_id: r for r in given.collect()}
        kept = {r.doc_id: r for r in made.collect()}
        assert set(kept) <= set(before)
        if name != "token_ids":
            assert made.columns == docs.columns and made.dtypes == docs.dtypes
        if name == "near_duplicates":
            assert set(kept) == {c for _, _, c in brute_classes([(r.doc_id, r.text) for r in before.values()])}
        if name == "benchmark":
            found = leaks.find(given.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert set(before) - set(kept) == {r.doc_id for r in found.collect() if r.leaks}
        if name == "secrets":
            assert set(kept) == set(before)
            changed = [i for i in kept if kept[i].text != before[i].text]
            assert changed and all("[secret]" in kept[i].text and kept[i].n_chars == len(kept[i].text) for i in changed)
            assert secrets.scan(made).filter("exists(secret_spans, s -> s.kind <> 'random')").isEmpty()
        if name == "token_ids":
            assert set(kept) == set(before) and all(len(r.ids) == r.n_tokens for r in kept.values())
        given = made
    assert corpus_pipeline.run(spark, sf_dir).count() == given.count()


def test_near_duplicates_that_share_ids(spark):
    """Rows with one id and different texts stay, but for copies of other rows."""
    texts = [prose(seed, 40) for seed in range(5)]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[2]), (5, texts[2]), (3, texts[0]), (8, texts[1]), (9, texts[3]), (None, texts[4]), (5, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert found == sorted([(3, texts[0]), (5, texts[1]), (5, texts[2]), (9, texts[3]), (0, texts[4]), (5, "")])


def test_pipeline_of_odd_documents(spark, tmp_path):
    docs = odd_docs(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for frame, rows in ((docs, {1, 2, 3, 4, 5, 6, 7, None}), (docs.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES[1:]:
            frame = blocks.stored(stage(spark, frame, str(tmp_path)), f"odd-{name}")
            assert {r.doc_id for r in frame.collect()} == rows and frame.count() == len(rows)
