"""The queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, centroids, decontam, embdedup, extract, langid, quality, simhash, tokencount, toxicity, urlfilter, warc
from .common import documents, fold, shared_dir


#: Texts with a quality score of at least this are taken for good ones.
GOOD = 0.3
#: Texts with a toxicity score of at least this are taken for toxic ones.
TOXIC = 0.3


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Fit on labels outside the held-out fold; another fold calibrates."""
    return quality.fit(docs, labels.filter(fold(F.col("doc_id"), 5) != 0), calibrate=fold(F.col("doc_id"), 5) == 4)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text for quality."""
    docs = documents(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, documents(spark, sf_dir, "labels").select("doc_id", "quality"))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def language_model(docs: DataFrame) -> langid.Model:
    """Fit on the languages of texts outside the held-out fold."""
    return langid.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every text."""
    docs = documents(spark, sf_dir, "documents")
    model = language_model(docs.select("doc_id", "text", "lang"))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


#: The listed rules of op2 (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every url by the listed rules, else by rules mined from what these
    block and allow."""
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    # The tables hold no judged urls but those that the listed rules judge.
    mined = urlfilter.mine(urlfilter.listed_labels(pages, URL_RULES))
    return urlfilter.judge(pages, URL_RULES, mined).select("page_id", "host", "path", "rule", "verdict", "mined_rules")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    return simhash.near_duplicates(documents(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids again, and digest both."""
    docs = documents(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def digests(decoded: DataFrame) -> DataFrame:
    """The digest columns of encoded and decoded texts."""
    return decoded.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    })


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article text of every page."""
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages, extract.fit(pages)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text."""
    docs = documents(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives, read them back, assemble captures."""
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(pages, path)
    found = warc.resolve(warc.captures(spark, path, payloads=False))
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast("long").alias("refers_to"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every text that holds it or a close version."""
    docs = documents(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.matches(docs, documents(spark, sf_dir, "benchmark"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embdedup.near_duplicates(documents(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (
  SELECT vec_id, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM v
)
SELECT c.vec_id, (SELECT count(*) FROM links WHERE a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM comp c
"""


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and centroid of every vector."""
    return centroids.cluster(documents(spark, sf_dir, "embeddings"))


def op11_sql(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """The rounds of ``op11_centroids`` as a chain of tables."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    part = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM kept ORDER BY h, x LIMIT {k})
)"""]
    for r in range(rounds + 1):
        part.append(f"a{r} AS MATERIALIZED (SELECT rid, min(d) AS d, arg_min(k, d * {k} + k) AS k FROM (SELECT v.rid, c.k, {square} AS d FROM kept v, c{r} c) GROUP BY rid)")
        if r < rounds:
            part.append(f"""s{r} AS MATERIALIZED (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT a.k, i, CAST(sum(v.x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN kept v USING (rid), range(1, 65) t(i) GROUP BY a.k, i) GROUP BY k
), c{r + 1} AS MATERIALIZED (SELECT k, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN s{r} s USING (k))""")
    return "WITH " + ", ".join(part) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} c USING (k)"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text for toxicity."""
    docs = documents(spark, sf_dir, "documents").select("doc_id", "text")
    labels = documents(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out, "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, in all orders, by language."""
    return audit.audit(documents(spark, sf_dir, "documents"), documents(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), f AS (
  SELECT part, doc_id, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e
  FROM w
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask, count(*) AS n,
         count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), o(filter_order, before, step, letter) AS (
  SELECT '', 0, 0, '' UNION ALL
  SELECT filter_order || x, before + CASE WHEN step = 0 THEN 0 ELSE CAST(pow(2, ascii(letter) - 65) AS INT) END, step + 1, x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
), s AS (
  SELECT p.filter_order, q.step, q.before, CAST(pow(2, ascii(q.letter) - 65) AS INT) AS mine FROM o p JOIN o q ON p.step = 5 AND q.step > 0 AND starts_with(p.filter_order, q.filter_order)
), r AS (
  SELECT part, filter_order, step, mine,
         sum(n) FILTER (WHERE mask & (before | mine) = 0) AS kept, sum(n) FILTER (WHERE mask & mine > 0 AND mask & before = 0) AS removed,
         sum(n) FILTER (WHERE mask & mine > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (WHERE mask = mine) AS unique_fails,
         sum(good) FILTER (WHERE mask & mine > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & mine > 0 AND mask & before = 0) AS toxic_lost
  FROM m, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query over the tables of a folder."""
    return {
        "op1_quality": op1_quality,
        "op2_url_rules": op2_url_rules,
        "op3_language": op3_language,
        "op4_simhash": op4_simhash,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_main_text": op6_main_text,
        "op7_token_counts": op7_token_counts,
        "op8_warc": op8_warc,
        "op9_decontamination": op9_decontamination,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_centroids": op11_centroids,
        "op12_toxicity": op12_toxicity,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL with the same rows."""
    return {"op8_warc": OP8_SQL, "op10_embedding_dedup": OP10_SQL, "op11_centroids": op11_sql(), "op13_filter_audit": OP13_SQL}
