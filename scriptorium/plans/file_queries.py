"""Work files made from ``documents``: each quotes 40 characters of its text, with faults planted by the document's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import work_files
from scriptorium.plans.queries import query
from scriptorium.session import spread, stored, table
from scriptorium.sources import work_files as source

_PARTS = [
    "doc_id", "text", "CASE WHEN doc_id % 13 = 5 THEN doc_id + 10000000 ELSE doc_id END AS document", "CASE doc_id % 3 WHEN 0 THEN 'quotation' WHEN 1 THEN 'support' ELSE 'background' END AS intent",
    "CASE WHEN doc_id % 7 = 2 THEN concat('zzqq ', substr(text, 21, 40)) ELSE substr(text, 21, 40) END AS quote", "CASE doc_id % 4 WHEN 1 THEN 'e1' WHEN 2 THEN 'e2' END AS edition_key", "CASE doc_id % 4 WHEN 3 THEN 'Second' END AS edition",
    "doc_id % 11 = 4 AS unmarked", "doc_id % 19 = 6 AS dangling", "doc_id % 23 = 8 AS invalid", "doc_id % 29 = 9 AS claimed", "CASE WHEN doc_id % 2 = 0 THEN 'published' ELSE 'draft' END AS status",
]


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("length(text) > 100").selectExpr(*_PARTS)


def works(spark: SparkSession, d: str) -> DataFrame:
    json = F.to_json(F.struct(F.lit("c1").alias("id"), "intent", F.col("document").cast("string").alias("document_id"), F.lit(20).alias("char_start"), F.lit(60).alias("char_end"), F.col("quote").alias("quoted_text"), "edition", "edition_key"))
    # Characters that YAML doesn't take as they stand are escaped.
    json = F.regexp_replace(F.regexp_replace(json, "\\u0085", r"\\\\u0085"), "\\u007f", r"\\\\u007f")
    content = F.concat(
        F.lit("---\nwork: w"), F.col("doc_id").cast("string"), F.lit("\ntitle: A work\ntype: essay\nstatus: "), "status", F.lit("\ncreated: 2020-01-02\nclaims: [r1"), F.when(F.col("claimed"), ", r9").otherwise(""),
        F.lit("]\ncitations:\n- "), json, F.when(F.col("invalid"), '\n- {"id": "c2", "intent": "quotation"}').otherwise(""), F.lit("\n---\nA body."), F.when(F.col("unmarked"), "").otherwise("[^c1]"),
        F.when(F.col("dangling"), " And[^c7].").otherwise(""), F.when(F.col("invalid"), " Or[^c2].").otherwise(""), F.lit("\n[^c9]: an old note\n"),
    )
    # Written once: every rule reads the parsed works.
    return stored(source.read_works(spread(parts(spark, d)).select(F.col("doc_id").cast("string").alias("path"), content.cast("binary").alias("content"))))


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    documents = docs.selectExpr("doc_id", "CASE WHEN doc_id % 6 > 0 THEN 'e1' END AS edition_key", "CASE WHEN doc_id % 9 > 0 THEN source END AS author", "CASE WHEN doc_id % 10 > 0 THEN lang END AS title", "CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '18621' ELSE '1862-03-04' END AS year")
    return documents, docs.where("doc_id % 17 <> 3").select("doc_id", "text"), docs.where("doc_id % 5 = 0").selectExpr("doc_id", "20 AS char_start", "60 AS char_end"), spark.createDataFrame([("r1",)], "ref string")


_BASE = f"""p AS (SELECT {", ".join(_PARTS)} FROM documents WHERE length(text) > 100),
v AS (SELECT *, trim(quote) AS asked, document <> doc_id AS unknown, doc_id % 17 = 3 AS textless, doc_id % 5 = 0 AS region, CASE WHEN doc_id % 6 > 0 THEN 'e1' END AS document_key FROM p),
e AS (SELECT *, CASE WHEN unknown OR textless THEN 'no_canonical_text' WHEN doc_id % 7 = 2 THEN 'not_found' ELSE 'exact' END AS verdict, strpos(text, asked) <> 21 OR length(asked) <> 40 AS moved FROM v),
s AS (SELECT *, CASE WHEN unknown THEN 1 WHEN textless THEN 2 WHEN verdict = 'not_found' THEN 3 WHEN moved THEN 4 WHEN intent = 'quotation' AND region THEN 5 WHEN edition_key <> document_key THEN 6 ELSE 7 END AS stop FROM e),
f AS (
  SELECT doc_id, 'AUTH_DOCUMENT_UNKNOWN' AS rule, 'error' AS severity, 'c1' AS citation_id, document::VARCHAR AS detail FROM s WHERE stop = 1
  UNION ALL SELECT doc_id, 'AUTH_SOURCE_UNCHECKABLE', 'error', 'c1', document::VARCHAR FROM s WHERE stop = 2
  UNION ALL SELECT doc_id, 'AUTH_QUOTE_UNVERIFIED', 'error', 'c1', 'not_found' FROM s WHERE stop = 3
  UNION ALL SELECT doc_id, 'AUTH_SOURCE_SPAN_STALE', 'error', 'c1', (strpos(text, asked) - 1) || '-' || (strpos(text, asked) - 1 + length(asked)) FROM s WHERE stop = 4
  UNION ALL SELECT doc_id, 'AUTH_SPAN_NOT_NARROWED', 'error', 'c1', NULL FROM s WHERE stop = 5
  UNION ALL SELECT doc_id, 'AUTH_SPAN_REGION', 'warning', 'c1', NULL FROM s WHERE stop > 5 AND intent = 'support' AND region
  UNION ALL SELECT doc_id, 'AUTH_CITATION_EDITION_MISSING', 'warning', 'c1', NULL FROM s WHERE stop > 5 AND edition_key IS NULL AND edition IS NULL
  UNION ALL SELECT doc_id, 'AUTH_EDITION_KEY_UNKNOWN', 'warning', 'c1', edition_key FROM s WHERE stop > 5 AND edition_key IS NOT NULL AND document_key IS NULL
  UNION ALL SELECT doc_id, 'AUTH_EDITION_KEY_MISMATCH', 'error', 'c1', document_key FROM s WHERE stop = 6
  UNION ALL SELECT doc_id, 'AUTH_CITATION_MARKER_MISSING', 'warning', 'c1', NULL FROM s WHERE stop = 7 AND unmarked
  UNION ALL SELECT doc_id, 'AUTH_ENTRY_INVALID', 'error', 'c2', 'invalid document_id, char_start, char_end, quoted_text' FROM p WHERE invalid
  UNION ALL SELECT doc_id, 'AUTH_CITATION_MARKER_DANGLING', 'error', 'c7', NULL FROM p WHERE dangling
  UNION ALL SELECT doc_id, 'AUTH_CLAIM_UNRESOLVED', 'error', NULL, 'r9' FROM p WHERE claimed),
g AS (SELECT * FROM f UNION ALL SELECT DISTINCT doc_id, 'AUTH_STATUS_UNEARNED', 'error', NULL, NULL FROM f JOIN p USING (doc_id) WHERE status = 'published' AND (severity = 'error' OR rule = 'AUTH_CITATION_EDITION_MISSING'))"""


def findings(spark: SparkSession, d: str, own: DataFrame | None = None) -> DataFrame:
    documents, texts, passages, claims = _tables(spark, d)
    return work_files.verify(works(spark, d) if own is None else own, documents, texts, passages, claims)


@query(f"WITH {_BASE} SELECT doc_id, rule, severity, citation_id, detail FROM g")
def work_file_findings(spark, d):
    return findings(spark, d, works(spark, d)).select(F.col("path").cast("long").alias("doc_id"), "rule", "severity", "citation_id", "detail")


@query(f"""WITH {_BASE}, b AS (SELECT DISTINCT doc_id, rule FROM g WHERE severity = 'error' OR rule = 'AUTH_CITATION_EDITION_MISSING')
SELECT p.doc_id, count(rule) = 0 AS passed, coalesce(string_agg(rule, ',' ORDER BY rule), '') AS blockers FROM p LEFT JOIN b ON b.doc_id = p.doc_id GROUP BY 1""")
def work_file_gate(spark, d):
    own = works(spark, d)
    judged = work_files.gate(own, findings(spark, d, own), publish=True)
    return judged.select(F.col("path").cast("long").alias("doc_id"), "passed", F.array_join("blockers", ",").alias("blockers"))


@query(f"""WITH {_BASE}, m AS (SELECT s.*, CASE WHEN NOT unknown AND s.doc_id % 9 > 0 THEN source END AS author, CASE WHEN NOT unknown AND s.doc_id % 10 > 0 THEN lang END AS title, CASE WHEN unknown OR s.doc_id % 8 = 0 THEN NULL WHEN s.doc_id % 8 = 1 THEN '18621' ELSE '1862' END AS year FROM s JOIN documents d ON d.doc_id = s.doc_id),
t AS (SELECT *, coalesce(author, 'document ' || document) || ', ' || coalesce('*' || title || '*', 'document ' || document) || coalesce(', ' || edition, '') || coalesce(' (' || year || ')', '') || '. [' || verdict || ']' || CASE WHEN author IS NULL OR title IS NULL OR year IS NULL THEN ' [provisional]' ELSE '' END AS note FROM m)
SELECT doc_id, 'A body.' || CASE WHEN unmarked THEN '' ELSE '[^c1]' END || CASE WHEN dangling THEN ' And[^c7].' ELSE '' END || CASE WHEN invalid THEN ' Or[^c2].' ELSE '' END || chr(10) || chr(10) || '[^c1]: ' || note || chr(10) AS text FROM t""")
def work_file_footnotes(spark, d):
    documents, texts, passages, _ = _tables(spark, d)
    own = works(spark, d)
    notes = work_files.footnotes(work_files.checked(own, documents, texts, passages), documents)
    return work_files.rendered(own, notes).select(F.col("path").cast("long").alias("doc_id"), "text")
