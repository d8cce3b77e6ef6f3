"""Quality classifier and language identification: held-out accuracy and odd rows."""

import numpy as np
import pytest
from helpers import odd_docs, same_columns
from pyspark.sql import functions as F

from fieldsurvey.llm import langid, quality
from fieldsurvey.llm.queries import QUERIES


def test_quality_on_held_out_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = QUERIES["op2_quality"](spark, sf_dir)
    assert found.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    loss = -np.mean([np.log(max(1e-9, r.score if r.quality else 1 - r.score)) for r in rows])
    assert loss < 0.35
    assert found.filter("score < 0 OR score > 1").isEmpty() and found.count() == 1000


@pytest.mark.parametrize("labels", [[], [(5, 1)], [(6, 0), (7, 1), (7, 0), (4, None), (3, 9)], [(i, 1) for i in range(20)]])
def test_quality_of_odd_rows(spark, labels):
    df = odd_docs(spark)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.classify(df, marks)
    same_columns(df.drop("text"), out, "score")
    rows = out.collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    if not labels:
        assert {r.score for r in rows} == {0.5}
    assert quality.classify(df.limit(0), marks).count() == 0


def test_quality_is_fitted_on_all_labelled_texts(spark, sf_dir, monkeypatch):
    """More labelled texts than one place fits: every one is learned from, in shards."""
    seen, fit_shards = [], quality.fit_shards
    monkeypatch.setattr(quality, "fit_shards", lambda rows, shards: seen.append((rows.count(), shards)) or fit_shards(rows, shards))
    monkeypatch.setattr(quality, "MAX_TRAIN", 60)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labels.filter(F.col("doc_id") % 3 != 1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality.classify(docs, known, out="p").join(labels, "doc_id").filter("doc_id % 3 = 1").collect()
    n = docs.join(known, "doc_id").count()
    assert seen == [(n, -(-n // 60))] and n > 120
    good, bad = [r.p for r in rows if r.quality], [r.p for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_labelled_texts_are_dealt_out_once(spark, monkeypatch):
    """Turns read the shards where they lie; each used to shuffle all features again, twice."""
    plans, summed = [], quality.summed
    monkeypatch.setattr(quality, "summed", lambda parts: plans.append(parts._jdf.queryExecution().toString()) or summed(parts))
    r = np.random.default_rng(1)
    x = r.normal(size=(900, quality.FEATURES)).astype(np.float32)
    rows = spark.createDataFrame([(int(v[0] > 0), v.tobytes(), i) for i, v in enumerate(x)], "y int, x binary, mark long")
    network = quality.fit_shards(rows, 3)
    assert len(plans) == quality.TURNS + 2 and not any("Exchange" in p for p in plans)
    assert np.mean((network.scores(x) > 0.5) == (x[:, 0] > 0)) > 0.8
    shards = quality.by_shard(rows, 3).collect()
    assert len(shards) == 6 and sum(len(s.y) // 8 for s in shards) == 900
    assert sorted(b"".join(s.x for s in shards)) == sorted(x.tobytes())


def test_network_learns_and_is_calibrated():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, quality.FEATURES))
    chance = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (r.random(3000) < chance).astype(float)
    scores = quality.fit(x[:2000], y[:2000]).scores(x[2000:])
    # Beyond what can be known the score follows the chance.
    assert np.corrcoef(scores, chance[2000:])[0, 1] > 0.7
    assert abs(scores.mean() - chance[2000:].mean()) < 0.08


def test_language_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op8_language_id"](spark, sf_dir).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang")
    cyrillic = spark.createDataFrame([("слово дело мир день " * 20, "ru"), (None, "ru"), ("no language", None)], "text string, lang string")
    return langid.learn(docs.unionByName(cyrillic))


def test_spans_of_mixed_text(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    parts = {r.lang: r.text[:400].rsplit(" ", 1)[0] for r in docs.filter("n_chars > 2000").dropDuplicates(["lang"]).collect()}
    text = parts["en"] + " " + parts["fr"] + " мир день слово дело " + parts["de"]
    row = langid.identify(spark.createDataFrame([(text,)], "text string"), model).first()
    assert [s.lang for s in row.lang_spans] == ["en", "fr", "ru", "de"]
    covered = [text[s.start : s.end] for s in row.lang_spans]
    assert covered[2] == "мир день слово дело" and parts["fr"].startswith(covered[1][:50])
    assert 0 < row.score < 1


def test_viterbi_against_all_paths():
    import itertools

    r = np.random.default_rng(1)
    scores = r.normal(size=(6, 3)).astype(np.float32)
    code, first = np.array([0, 1, 2, 3, 4, 5, 0, 3]), np.array([0, 5, 5, 8])
    found = langid.viterbi(scores, code, first, 0.7)
    for a, b in zip(first[:-1], first[1:]):
        if a < b:
            worth = lambda p: sum(scores[code[a + i], s] for i, s in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))
            best = max(worth(p) for p in itertools.product(range(3), repeat=b - a))
            assert worth(found[a:b]) == pytest.approx(best, rel=1e-5)


def test_language_of_odd_rows(spark, model):
    df = odd_docs(spark)
    out = langid.identify(df, model)
    same_columns(df, out, "lang_pred", "score", "lang_spans")
    found = {r.n: r for r in out.collect()}
    for n in range(4):
        assert (found[n].lang_pred, found[n].score, found[n].lang_spans) == ("und", 0.0, [])
    assert all(found[n].lang_pred in model.names for n in range(4, 9))
    assert langid.identify(df.limit(0), model).count() == 0
    nothing = langid.learn(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
