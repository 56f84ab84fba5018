"""Queries of the training-data operators over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import ann, clusters, decontaminate, divergence, exact_dedup, html_extract, mixing, near_dup, packing, quality, token_counts, token_output, warc

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(read(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_components(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(read(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "pipeline": pipeline,
    "op9_token_counts": op9_token_counts,
    "op7_ann": op7_ann,
    "op2_html": op2_html,
    "op4_warc": op4_warc,
    "op6_mixing": op6_mixing,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op1_quality": op1_quality,
    "op3_token_output": op3_token_output,
    "op5_packing": op5_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_divergence": op12_divergence,
    "op13_clusters": op13_clusters,
}

OP10_SQL = r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM keyed WINDOW g AS (PARTITION BY text_sha256)
"""

OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_page THEN NULL ELSE first_page END AS refers_to
FROM f
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
),
words AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT row_id) >= 3),
kept_counts AS (SELECT lang, source, term, n FROM counts JOIN kept USING (lang, term)),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total, any_value(coalesce(v, 0)) AS v FROM groups g LEFT JOIN kept_counts k ON g.lang = k.lang AND g.source = k.source LEFT JOIN sizes s ON g.lang = s.lang GROUP BY ALL),
grid AS (
  SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p
  FROM totals t JOIN kept k ON t.lang = k.lang LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
),
whole AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // ((SELECT sum(total) FROM totals t WHERE t.lang = k.lang) + (SELECT v FROM sizes s WHERE s.lang = k.lang)) AS q
  FROM kept_counts k GROUP BY lang, term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
part_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
),
part_term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM grid JOIN whole USING (lang, term) WHERE n > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (FROM part_pair UNION ALL FROM part_term)
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""



def _op13_sql(k: int = 16, rounds: int = 3, width: int = 64) -> str:
    """Plain k-means, round by round: the vectors' components as rows."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: isfinite(x))) = {width}
)""",
        f"""centre0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS cluster, v AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {k})""",
    ]
    square = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        parts.append(f"near{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := {square}, cluster := cluster)) AS best FROM kept CROSS JOIN centre{r} GROUP BY vec_id)")
        if r < rounds:
            parts.append(
                f"""mean{r} AS (
  SELECT cluster, list(m ORDER BY i) AS c FROM (
    SELECT best.cluster AS cluster, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM near{r}, range(1, {width + 1}) t(i) GROUP BY ALL
  ) GROUP BY cluster
), centre{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM centre{r} o LEFT JOIN mean{r} m USING (cluster))"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds} JOIN centre{rounds} ON cluster = best.cluster"""


OP11_SQL = r"""
WITH item_words AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i + 1, i + 10) AS win FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM item_words WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
doc_words AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
slices AS (SELECT row_id, i, n, list_slice(w, i + 1, i + n) AS win FROM (SELECT row_id, w, unnest(range(len(w))) AS i FROM doc_words), lengths WHERE i + n <= len(w)),
hits AS (SELECT row_id, i, n, item_id FROM slices JOIN windows USING (win)),
hit_words AS (SELECT row_id, count(DISTINCT pos) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT row_id, i, n FROM hits)) GROUP BY row_id),
hit_items AS (SELECT row_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY encode(item_id))) AS items_sha256 FROM (SELECT DISTINCT row_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (row_id) LEFT JOIN hit_items USING (row_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op11_decontamination": OP11_SQL,
    "op13_clusters": _op13_sql(),
    "op12_divergence": OP12_SQL,
    "op4_warc": OP4_SQL,
    "op10_exact_dedup": OP10_SQL,
}
