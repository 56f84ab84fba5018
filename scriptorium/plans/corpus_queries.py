"""The corpus report over passages, trees, words and extractions made from ``documents``, with faults planted by shared expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import diagnostics
from scriptorium.plans.queries import query
from scriptorium.plans.structure_queries import _D, _P, texts, windows

VERSIONS = {"fixed_window": "4.0", "prose_window": "4.0"}
_PASSAGES = [
    "passage_id", "doc_id", "CASE WHEN doc_id % 7 <> 3 THEN char_start END AS char_start", "CASE WHEN doc_id % 11 = 5 THEN char_start - 1 WHEN doc_id % 13 = 1 THEN char_end + 100000 ELSE char_end END AS char_end",
    "CASE WHEN doc_id % 17 = 2 THEN concat('x', piece) WHEN doc_id % 19 = 4 THEN '   ' WHEN doc_id % 29 = 6 AND position = 0 THEN repeat(piece, 40) ELSE piece END AS text",
    "doc_id * 10 + position % 3 + CASE WHEN doc_id % 31 = 8 THEN 10 ELSE 0 END AS node_id", "CASE position % 2 WHEN 0 THEN 'fixed_window' ELSE 'prose_window' END AS chunker", "CASE WHEN doc_id % 5 = 0 THEN '3.0' ELSE '4.0' END AS chunker_version",
]
_DOCUMENTS = ["doc_id", "CASE doc_id % 3 WHEN 0 THEN concat('https://host/', CAST(doc_id AS STRING)) WHEN 1 THEN '/data/a:b.txt' ELSE 'pack:item' END AS source"]
_NODES = [
    "doc_id * 10 + k AS node_id", "doc_id", "CASE WHEN k > 0 THEN doc_id * 10 END AS parent_id", "CASE WHEN k = 2 THEN CAST(floor(n / 2) AS INT) ELSE 0 END AS char_start",
    "CASE k WHEN 0 THEN n - CASE WHEN doc_id % 37 = 9 THEN 5 ELSE 0 END WHEN 1 THEN CAST(floor(n / 2) AS INT) ELSE n + CASE WHEN doc_id % 41 = 10 THEN 1000 ELSE 0 END END AS char_end",
]
_WORDS = ["passage_id AS word_id", "doc_id", "char_start", "CASE WHEN doc_id % 59 = 14 THEN char_start + 100000 ELSE least(char_start + 7, char_end) END AS char_end", "CASE WHEN doc_id % 53 = 13 THEN 'zzz' ELSE substr(piece, 1, 7) END AS surface"]
_EXTRACTIONS = ["passage_id AS extraction_id", "CASE position % 4 WHEN 1 THEN 'failed' ELSE 'ok' END AS status", "CASE position % 5 WHEN 2 THEN '[]' ELSE '[{\"a\": 1}]' END AS records"]
_RECORDS = ["passage_id AS record_id", "passage_id AS extraction_id", "passage_id", "CASE WHEN doc_id % 61 = 15 THEN -1 ELSE 0 END AS evidence_start", "CASE WHEN doc_id % 67 = 16 THEN NULL WHEN doc_id % 71 = 17 THEN 100000 ELSE 1 END AS evidence_end"]
_S = lambda columns: "SELECT " + ", ".join(columns)
_OFFENDERS = f"""{_D}, {_P}, w AS (SELECT p.*, substr(text, char_start + 1, char_end - char_start) AS piece FROM p JOIN d USING (doc_id)),
ps AS ({_S(_PASSAGES)} FROM w), ds AS ({_S(_DOCUMENTS)} FROM d), ts AS (SELECT doc_id, text FROM d WHERE doc_id % 23 <> 7), ns AS ({_S(_NODES)} FROM d, range(3) r(k)), ws AS ({_S(_WORDS)} FROM w),
es AS ({_S(_EXTRACTIONS)} FROM w), rs AS ({_S(_RECORDS)} FROM w WHERE position % 6 <> 3),
lost AS (SELECT ps.*, contains(source, ':') AND NOT starts_with(source, '/') AS uri FROM ps JOIN ds USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM ts)),
big AS (SELECT *, doc_id % 5 <> 0 AS in_use FROM ps WHERE greatest(0, 2 * length(text) - octet_length(encode(text))) / 4.0 + (octet_length(encode(text)) - length(text)) / 1.5 > 1200),
spanned AS (SELECT ps.*, ts.text AS whole, char_start < 0 OR char_end > length(ts.text) AS past FROM ps JOIN ts USING (doc_id) WHERE char_start IS NOT NULL),
worded AS (SELECT ws.*, text AS whole FROM ws JOIN ts USING (doc_id)),
found AS (
  SELECT 'passage_span_well_formed' AS "check", passage_id::VARCHAR AS id FROM ps WHERE char_end < char_start
  UNION ALL SELECT 'passage_has_offsets', passage_id::VARCHAR FROM ps JOIN ts USING (doc_id) WHERE char_start IS NULL
  UNION ALL SELECT CASE WHEN uri THEN 'passage_offsets_need_a_pack_reingest' ELSE 'passage_offsets_recoverable_by_reparse' END, passage_id::VARCHAR FROM lost WHERE char_start IS NULL
  UNION ALL SELECT DISTINCT CASE WHEN uri THEN 'document_text_needs_a_pack_reingest' ELSE 'document_has_canonical_text' END, doc_id::VARCHAR FROM lost
  UNION ALL SELECT 'passage_is_not_empty', passage_id::VARCHAR FROM ps WHERE trim(text) = ''
  UNION ALL SELECT 'passage_is_not_oversized', passage_id::VARCHAR FROM big WHERE NOT in_use
  UNION ALL SELECT 'current_chunkers_are_not_emitting_oversized_passages', chunker || ' ' || chunker_version || ': ' || length(text) || ' chars' FROM big WHERE in_use
  UNION ALL SELECT 'passages_on_current_chunker_versions', passage_id::VARCHAR FROM ps WHERE chunker_version <> '4.0'
  UNION ALL SELECT 'passage_span_within_the_text', passage_id::VARCHAR FROM spanned WHERE past
  UNION ALL SELECT 'passage_text_matches_its_span', passage_id::VARCHAR FROM spanned WHERE NOT past AND (CASE WHEN char_end < char_start THEN '' ELSE substr(whole, char_start + 1, char_end - char_start) END) <> text
  UNION ALL SELECT 'node_span_within_the_text', node_id::VARCHAR FROM ns JOIN ts USING (doc_id) WHERE char_end > length(text)
  UNION ALL SELECT 'word_span_is_inside_its_document', word_id::VARCHAR FROM worded WHERE char_end > length(whole)
  UNION ALL SELECT 'word_span_quotes_its_word', word_id::VARCHAR FROM worded WHERE substr(whole, char_start + 1, char_end - char_start) <> surface
  UNION ALL SELECT DISTINCT 'word_has_document_text_to_address', doc_id::VARCHAR FROM ws WHERE doc_id NOT IN (SELECT doc_id FROM ts)
  UNION ALL SELECT 'passage_is_embedded', passage_id::VARCHAR FROM ps WHERE doc_id % 43 = 11
  UNION ALL SELECT 'passage_is_indexed_for_keywords', passage_id::VARCHAR FROM ps WHERE doc_id % 47 = 12
  UNION ALL SELECT 'node_sits_inside_its_parent', c.node_id::VARCHAR FROM ns c JOIN ns p ON p.node_id = c.parent_id WHERE c.char_start < p.char_start OR c.char_end > p.char_end
  UNION ALL SELECT 'passage_node_is_in_the_same_document', passage_id::VARCHAR FROM ps JOIN ns USING (node_id) WHERE ns.doc_id <> ps.doc_id
  UNION ALL SELECT 'extraction_evidence_is_anchored', record_id::VARCHAR FROM rs JOIN ps USING (passage_id) WHERE evidence_start < 0 OR evidence_end IS NULL OR evidence_end > length(text) OR evidence_end <= evidence_start
  UNION ALL SELECT 'extraction_records_are_materialized', extraction_id::VARCHAR FROM es WHERE status = 'ok' AND records <> '[]' AND extraction_id NOT IN (SELECT extraction_id FROM rs))"""
_LISTED = ", ".join(f"('{name}', '{severity}')" for name, severity in diagnostics.CHECKS.items())


def corpus(spark: SparkSession, d: str) -> diagnostics.Corpus:
    docs = texts(spark, d)
    passage, start = (F.col("doc_id") * 100000 + F.col("position")).alias("passage_id"), F.col("position") * 300
    at = windows(docs, 300)
    cut = docs.select("doc_id", F.posexplode(T.windows(F.col("text"), 300)).alias("position", "piece")).select(passage, "doc_id", "position", start.alias("char_start"), (start + F.length("piece")).alias("char_end"), "piece")
    return diagnostics.Corpus(
        passages=cut.selectExpr(*_PASSAGES), documents=docs.selectExpr(*_DOCUMENTS), texts=docs.where("doc_id % 23 <> 7").select("doc_id", "text"),
        nodes=docs.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).selectExpr(*_NODES), embedded=at.where("doc_id % 43 <> 11").select("passage_id"), indexed=at.where("doc_id % 47 <> 12").select("passage_id"),
        words=cut.selectExpr(*_WORDS), extractions=at.selectExpr(*_EXTRACTIONS), records=at.where("position % 6 <> 3").selectExpr(*_RECORDS),
    )


@query(f'WITH {_OFFENDERS} SELECT "check", id FROM found')
def corpus_offenders(spark, d):
    return diagnostics.offenders(corpus(spark, d), VERSIONS)


@query(f"""WITH {_OFFENDERS}, ranked AS (SELECT "check", id, row_number() OVER (PARTITION BY "check" ORDER BY encode(id)) AS nth FROM found),
few AS (SELECT "check", max(n) AS n, string_agg(id, ',' ORDER BY nth) FILTER (WHERE nth <= 5) AS samples FROM ranked JOIN (SELECT "check", count(*) AS n FROM found GROUP BY 1) USING ("check") GROUP BY 1),
listed AS (SELECT * FROM (VALUES {_LISTED}) v("check", severity))
SELECT "check", severity, false AS skipped, coalesce(n, 0)::BIGINT AS n, coalesce(samples, '') AS samples, row_number() OVER (ORDER BY n IS NULL, CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, "check")::INT AS place FROM listed LEFT JOIN few USING ("check")""")
def corpus_report(spark, d):
    return diagnostics.report(corpus(spark, d), VERSIONS)
