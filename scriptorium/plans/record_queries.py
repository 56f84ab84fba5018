"""Queries over records that a model might have given for passages of ``documents``, and over first pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import identifiers
from scriptorium.functions import text as T
from scriptorium.operators import extraction
from scriptorium.plans.queries import query
from scriptorium.plans.structure_queries import _D, _P, texts
from scriptorium.session import spread, table

KINDS = {
    "claim": {"assertion": {"required": True}, "quote": {"type": "evidence_span"}},
    "event": {"date": {"type": "fuzzy_date"}, "count": {"type": "integer", "required": True}, "quote": {"type": "evidence_span"}, "also": {"type": "evidence_span"}},
}
# White space inside the quotation is retyped as single spaces.
_RECORDS = [
    "passage_id", "piece", "CASE position % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'event' ELSE CASE WHEN doc_id % 7 = 1 THEN 'rumour' ELSE 'claim' END END AS record_type", "trim(substr(piece, 11, 60)) AS cut", "doc_id % 11 = 2 AS absent", "doc_id % 13 = 3 AS silent",
    "doc_id % 17 = 4 AS number", "doc_id % 5 AS count", "CASE WHEN doc_id % 19 = 5 THEN '' WHEN doc_id % 23 <> 6 THEN 'said' END AS assertion", "CASE WHEN doc_id % 29 = 7 THEN 'zzqq' WHEN doc_id % 2 = 0 THEN trim(substr(piece, 1, 10)) END AS also", "doc_id % 31 = 8 AS listed",
]


def records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = texts(spark, d)
    at = docs.select("doc_id", F.posexplode(T.windows(F.col("text"), 300)).alias("position", "piece"))
    cut = at.select("doc_id", "position", (F.col("doc_id") * 100000 + F.col("position")).alias("passage_id"), "piece")
    made = cut.selectExpr(*_RECORDS)
    quote = F.when(F.col("absent"), F.concat(F.lit("zzqq "), "cut")).otherwise(F.regexp_replace("cut", r"\s+", " "))
    string = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), F.get(F.split(F.to_json(F.struct(value.alias("x"))), r'^\{"x":|\}$'), 1)))
    fields = F.concat(F.lit("{"), F.concat_ws(",", string("assertion", F.col("assertion")), F.concat(F.lit('"count":'), F.col("count").cast("string")), F.when(F.col("number"), F.lit('"quote":5')).otherwise(F.when(~F.col("silent"), string("quote", quote))), string("also", F.col("also"))), F.lit("}"))
    rows = made.select(F.col("passage_id").alias("extraction_id"), "passage_id", F.lit(0).alias("n"), "record_type", F.when(F.col("listed"), F.concat(F.lit("["), fields, F.lit("]"))).otherwise(fields).alias("fields"))
    return rows, made.select("passage_id", F.col("piece").alias("text"))


@query(f"""WITH {_D}, {_P}, m AS (SELECT {", ".join(_RECORDS)} FROM (SELECT p.*, substr(text, char_start + 1, char_end - char_start) AS piece FROM p JOIN d USING (doc_id))),
j AS (SELECT *, record_type = 'event' AS event, number OR NOT silent AS quoted, record_type = 'event' AND also IS NOT NULL AS more, regexp_replace(cut, '\\s+', ' ', 'g') AS typed FROM m),
f AS (SELECT *, CASE WHEN record_type = 'rumour' THEN 'unknown record type' WHEN listed THEN 'no fields' WHEN NOT event AND coalesce(assertion, '') = '' THEN 'missing assertion' WHEN event AND count = 0 THEN 'missing count'
WHEN number THEN 'quote is no quotation' WHEN quoted AND (absent OR trim(typed) = '') THEN 'quote is not in the passage' WHEN more AND (also = 'zzqq' OR regexp_replace(also, '\\s', '', 'g') = '') THEN 'also is not in the passage' WHEN NOT quoted AND NOT more THEN 'quotes nothing' END AS fault FROM j),
r AS (SELECT *, CASE WHEN quoted THEN CASE WHEN contains(piece, typed) THEN typed ELSE regexp_replace(cut, '^\\s+|\\s+$', '', 'g') END ELSE also END AS held FROM f)
SELECT passage_id, record_type, fault, CASE WHEN fault IS NULL THEN strpos(piece, held) - 1 END::INT AS evidence_start, CASE WHEN fault IS NULL THEN strpos(piece, held) - 1 + length(held) END::INT AS evidence_end FROM r""")
def anchored_records(spark, d):
    return extraction.anchored(*records(spark, d), KINDS).select("passage_id", "record_type", "fault", "evidence_start", "evidence_end")


# A part's page names identifiers by its number, some of them wrong, after which its name stands.
_PAGES = [
    "p_partkey", "CASE WHEN p_partkey % 17 = 0 THEN concat('own:', p_name) WHEN p_partkey % 17 = 1 THEN '  ' END AS edition_key", "CASE WHEN p_partkey % 13 = 2 THEN concat('https://doi.org/10.1234/AB%28', CAST(p_partkey AS STRING), ').') END AS doi", "CASE WHEN p_partkey % 11 = 3 THEN '0-306-40615-2' END AS isbn",
    """concat('Page of ', p_name, CASE p_partkey % 8 WHEN 0 THEN concat(' (doi:10.5555/', CAST(p_partkey AS STRING), '/X(1)). ') WHEN 1 THEN concat(' see http://www.jstor.org/stable/Ab', CAST(p_partkey AS STRING), '). ') WHEN 2 THEN ' ISBN-13: 978-0-306-40615-7 ' WHEN 3 THEN ' ISBN 0-306-40615-3 ' WHEN 4 THEN ' 10.123/short ' WHEN 5 THEN ' ISBN: 080442957X' ELSE '' END, p_type, repeat(' ', 12000), ' 10.9999/late') AS page""",
]


@query(f"""WITH p AS (SELECT {", ".join(_PAGES)} FROM part), q AS (SELECT p_partkey, edition_key, CASE WHEN p_partkey % 13 = 2 THEN '10.1234/ab(' || p_partkey || ')' WHEN p_partkey % 8 = 0 THEN '10.5555/' || p_partkey || '/x(1)' END AS doi,
CASE WHEN p_partkey % 8 = 1 THEN 'ab' || p_partkey END AS jstor, CASE WHEN p_partkey % 11 = 3 OR p_partkey % 8 = 2 THEN '9780306406157' WHEN p_partkey % 8 = 5 THEN '9780804429573' END AS isbn FROM p)
SELECT p_partkey, CASE WHEN trim(edition_key) <> '' THEN edition_key WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN jstor IS NOT NULL THEN 'jstor:' || jstor WHEN isbn IS NOT NULL THEN 'isbn:' || isbn END AS edition_key,
CASE WHEN coalesce(trim(edition_key), '') = '' THEN doi END AS doi, CASE WHEN coalesce(trim(edition_key), '') = '' AND doi IS NULL THEN 'https://www.jstor.org/stable/' || jstor END AS jstor_stable_url,
CASE WHEN coalesce(trim(edition_key), '') = '' AND doi IS NULL AND jstor IS NULL THEN isbn END AS isbn FROM q""")
def first_page_identity(spark, d):
    pages = spread(table(spark, d, "part")).selectExpr(*_PAGES)
    page = identifiers.first_page(F.col("page"), F.lit(None).cast("int"))
    return pages.select("p_partkey", identifiers.identity(page, F.col("edition_key"), F.col("doi"), F.col("isbn")).alias("i")).select("p_partkey", "i.*")
