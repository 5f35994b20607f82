"""The registered queries opN_<name> over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfeed.llm._common import load


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.pii import detect

    return detect(load(spark, sf_dir, "documents"), fit_spans=20_000)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.warc_zip import round_trip

    return round_trip(spark, load(spark, sf_dir, "pages"), revisit_bytes=100).drop("url")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.jaccard_join import Similarity, near_components

    return near_components(load(spark, sf_dir, "documents"), k=3, similarity=Similarity(9, 10)).drop("n_links")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.mixing import with_copies

    taken = with_copies(load(spark, sf_dir, "documents"), weights=[5, 2, 1], share=1.5, most=2.0, seed=17)
    return taken.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(load(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.token_counts import count_tokens

    return count_tokens(load(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.packing import pack

    return pack(load(spark, sf_dir, "documents"), tokenizer_path(), longest=4096, end_id=2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.language_id import identify

    return identify(load(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.html_extract import extract

    return extract(load(spark, sf_dir, "pages"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.topk_search import top_k

    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.centroid_clusters import cluster

    return cluster(load(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed="3")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.token_alignment import align_tokens

    return align_tokens(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.llm.embedding_dedup import near_components

    return near_components(load(spark, sf_dir, "embeddings"), similarity=0.9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_spans": op1_pii_spans,
    "op2_warc_zip": op2_warc_zip,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_source_mix": op4_source_mix,
    "op5_token_counts": op5_token_counts,
    "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_html_text": op9_html_text,
    "op10_topk_search": op10_topk_search,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_token_alignment": op12_token_alignment,
    "op13_embedding_dedup": op13_embedding_dedup,
}


def _centroid_sql(rounds: int = 10) -> str:
    """Every distance in full, round after round; distance and number are packed into one integer."""
    parts = ["""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 8))"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, min(CAST(list_inner_product(kept.v, kept.v) - 2 * list_inner_product(kept.v, c{i}.v) + list_inner_product(c{i}.v, c{i}.v) AS BIGINT) * 8 + c) AS m
  FROM kept, c{i} GROUP BY r)""")
        if i < rounds:
            parts.append(f"""
s{i} AS (
  SELECT m % 8 AS c, i, floor(sum(v[i]) / count(*)) AS x FROM a{i} JOIN kept USING (r), generate_series(1, 64) AS g(i) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM s{i} GROUP BY c) n USING (c))""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, CAST(m % 8 AS INTEGER) AS cluster, m // 8 AS distance, CAST(sum(m // 8) OVER (PARTITION BY m % 8) AS BIGINT) AS cluster_inertia,
  CAST(sum(m // 8) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c ON c.c = m % 8
"""

SQL: dict[str, str] = {
    "op2_warc_zip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
r AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM r
""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
named AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN named USING (doc_id)
""",
    "op4_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM by_source),
weighed AS (
  SELECT *, CAST([5, 2, 1][n % 3 + 1] AS BIGINT) AS weight, CAST(source_size AS DOUBLE) * 2 AS cap FROM ranked),
filled AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, n) AS pos,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(cap) OVER before, 0)) / (CAST(sum(weight) OVER () AS DOUBLE) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT min(pos) AS pos, arg_min(level, pos) AS level FROM filled WHERE cap > level * weight),
rates AS (
  SELECT source, source_size, CASE WHEN free.pos IS NULL OR filled.pos < free.pos THEN cap ELSE least(cap, free.level * weight) END AS target FROM filled, free),
drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':17'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn
""",
    "op10_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_centroid_clusters": _centroid_sql(),
    "op13_embedding_dedup": """
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
    embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS part FROM embeddings),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM (SELECT * FROM rows WHERE part) a JOIN (SELECT * FROM rows WHERE part) b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(r, to_r) AS (SELECT r, r FROM rows UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.to_r = links.a),
named AS (SELECT reach.r, min(rows.vec_id) AS component_id FROM reach JOIN rows ON rows.r = reach.to_r GROUP BY reach.r),
counted AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM rows JOIN named USING (r) LEFT JOIN counted USING (r)
""",
}
