"""The operators over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsurvey.llm import audit, bpe, jaccard, langid, leaks, ngram_lm, prefixfree, quality, quotes, secrets, topk, url_rules, walsh

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int) -> Column:
    """Remainder of crc32 of the id as text; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="decoded", keep_text=False))


def digests(coded: DataFrame, *more: str) -> DataFrame:
    return coded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Host, path and verdict of the rules of the URL query.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def _fitting(host: str, path: str, verdict: str) -> str:
    return f"""WHEN (host = '{host}' OR host LIKE '%.{host}') AND path LIKE '{path}%' THEN"""


SQL["op4_url_rules"] = f"""
WITH rest AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path
    FROM rest
)
SELECT page_id, host, path,
    CASE {" ".join(f"{_fitting(*r)} '{r[0]}{r[1]}'" for r in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])))} END AS rule,
    CASE {" ".join(f"{_fitting(*r)} '{r[2]}'" for r in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])))} ELSE 'allow' END AS verdict
FROM parts
"""


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs)
    of_kind = lambda kind: F.filter("secret_spans", lambda s: s["kind"] == kind)
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("secret_spans")).alias("spans"),
    )


@query
def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return quotes.thread(turns).select("conv_id", "turn", "role", "body", "n_quoted", "n_linked", "reply_to", "depth")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(3) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(fold(3) != 1)
    scored = quality.classify(docs, labels)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


SQL["op6_top_k"] = """
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores
)
SELECT * FROM ranked WHERE rank <= 20
"""


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold(4) == 2).alias("held_out"))
    model = langid.learn(docs.filter(~F.col("held_out")))
    found = langid.identify(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(7) == 2).alias("held_out"))
    return ngram_lm.score(docs, ~F.col("held_out"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit(docs, table(spark, sf_dir, "labels"))


# Written from the definition of each step: the first failing filter of a mask in an order takes its rows.
SQL["op11_filter_audit"] = r"""
WITH marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), failing AS (
    SELECT part, doc_id,
        (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END) AS fails
    FROM texts
), cells AS (
    SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
    FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), met AS (
    SELECT part, fails, n, good, toxic, filter_order,
        list_min(list_transform(string_split(CASE WHEN fails = '' THEN NULL ELSE fails END, ''), lambda x: strpos(filter_order, x))) AS first_step
    FROM cells, orders
), steps AS (
    SELECT part, filter_order, s::INTEGER AS step, substr(filter_order, s, 1) AS letter,
        sum(CASE WHEN first_step IS NULL OR first_step > s THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN first_step = s THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN first_step < s AND contains(fails, substr(filter_order, s, 1)) THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = substr(filter_order, s, 1) THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN first_step = s THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN first_step = s THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM met, range(1, 6) AS r(s) GROUP BY part, filter_order, s
)
SELECT * EXCLUDE (letter), sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM steps
"""


@query
def op12_walsh_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    listed = F.concat_ws(",", F.col("centroid").cast("array<string>"))
    return walsh.cluster(vectors).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(listed, 256).alias("centroid_sha256")
    )


def _assigned_sql(number: int) -> str:
    """Every vector with its nearest centroid of one round."""
    return f"""a{number} AS (
    SELECT row, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT k.row, k.vec_id, k.v, c.c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT AS d
        FROM kept k, c{number} c
    ) GROUP BY row, vec_id, v
)"""


def _moved_sql(number: int) -> str:
    """Centroids after one round; the floor of a quotient without division of fractions."""
    return f"""c{number + 1} AS (
    SELECT c, coalesce(m.v, old.v) AS v FROM c{number} old LEFT JOIN (
        SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
            SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{number}, range(1, 65) AS r(i) GROUP BY c, i
        ) GROUP BY c
    ) m USING (c)
)"""


SQL["op12_walsh_clusters"] = f"""
WITH kept AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < 16
), {", ".join(f"{_assigned_sql(r)}, {_moved_sql(r)}" for r in range(3))}, {_assigned_sql(3)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)
"""


@query
def op13_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefixfree.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
