"""Queries over chapters with numbered verses, made from the lines of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import verses
from scriptorium.plans.queries import query
from scriptorium.session import spread, table

# A document is a chapter (its id modulo 150, from 1), each line that isn't blank a verse; every eighth chapter has a line without its number.
_CHAPTERS = r"""b AS (SELECT doc_id, (doc_id % 150 + 1)::INT AS chapter, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE length(text) > 0),
v AS (SELECT doc_id, chapter, n, l[n] AS line, CASE WHEN n = 1 THEN chapter || ' ' ELSE '' END || n || ' ' || chr(9) AS label FROM (SELECT *, unnest(generate_series(1, len(l))) AS n FROM b WHERE doc_id % 8 <> 7)),
r AS (SELECT doc_id, chapter, n::INT AS number, (coalesce(sum(length(label) + length(line) + 6) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(label))::INT AS char_start, length(line)::INT AS n_chars, line FROM v)"""


def chapters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("length(text) > 0")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    number = (F.col("doc_id") % 150 + 1).cast("int")
    label = lambda i: F.when(i == 0, F.concat(number.cast("string"), F.lit(" "))).otherwise(F.lit(""))
    text = F.array_join(F.transform("l", lambda x, i: F.concat(label(i), (i + 1).cast("string"), F.lit(" \t"), x, F.lit(" "))), verses.SEPARATOR)
    broken = F.when(F.col("doc_id") % 8 == 7, F.regexp_replace(text, r"^\d+ 1 \t", "")).otherwise(text)
    return spread(docs).select("doc_id", number.alias("chapter"), lines.alias("l")).where("size(l) > 0").select("doc_id", "chapter", broken.alias("text"))


def found(spark: SparkSession, d: str) -> DataFrame:
    return verses.regions(verses.read_chapters(chapters(spark, d), "labelled"))


@query(f"WITH {_CHAPTERS} SELECT doc_id, chapter, number, char_start, char_start + n_chars AS char_end FROM r")
def labelled_verses(spark, d):
    return found(spark, d).select("doc_id", "chapter", "number", "char_start", "char_end")


@query(f"WITH {_CHAPTERS} SELECT doc_id, chapter, CASE WHEN doc_id % 8 = 7 THEN 'no such layout' ELSE '' END AS faults FROM b WHERE len(l) > 0")
def chapter_readings(spark, d):
    return verses.read_chapters(chapters(spark, d), "labelled").select("doc_id", "chapter", F.array_join("faults", "; ").alias("faults"))


# Windows of 300 characters of a chapter; a verse belongs to those that show one of its visible characters.
@query(f"""WITH {_CHAPTERS}, z AS (SELECT doc_id, max(char_start + n_chars + 1) AS size FROM r GROUP BY 1),
p AS (SELECT doc_id * 100000 + i AS passage_id, doc_id, 300 * i AS s, least(300 * i + 300, size) AS e FROM (SELECT *, unnest(generate_series(0, (size - 1) // 300)) AS i FROM z)),
h AS (SELECT passage_id, any_value(chapter) AS chapter, list_sort(list(number)) AS verses FROM p JOIN r ON r.doc_id = p.doc_id AND char_start < e AND char_start + n_chars > s AND regexp_matches(substr(line, greatest(s - char_start, 0) + 1, least(e, char_start + n_chars) - greatest(s, char_start)), '[^\\s\\p{{Z}}]') GROUP BY 1)
SELECT passage_id, array_to_string(verses, ',') AS verses, 'B ' || chapter || ':' || verses[1] || CASE WHEN len(verses) > 1 THEN '-' || verses[-1] ELSE '' END AS locator FROM h""")
def passage_verses(spark, d):
    texts = chapters(spark, d).where("doc_id % 8 <> 7")
    at = texts.select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 300).cast("int"))).alias("i"))
    passages = at.select((F.col("doc_id") * 100000 + F.col("i")).alias("passage_id"), "doc_id", (F.col("i") * 300).alias("char_start"), F.least(F.col("i") * 300 + 300, F.col("n")).alias("char_end"))
    of = verses.verses_of(passages, found(spark, d), texts)
    doc = F.floor(F.col("passage_id") / 100000)
    return verses.locators(of, F.lit("B"), (doc % 150 + 1).cast("int")).select("passage_id", F.array_join("verses", ",").alias("verses"), "locator")


# Every fifth verse isn't claimed; marks claim the numbers' labels of the others.
@query(f"""WITH {_CHAPTERS}, t AS (SELECT doc_id, string_agg(label || line || ' ', chr(10) || chr(10) || ' ' || chr(10) || chr(10) ORDER BY n) AS text FROM v GROUP BY 1),
c AS (SELECT doc_id, char_start AS s, char_start + n_chars AS e FROM r WHERE number % 5 <> 0 UNION ALL SELECT doc_id, length(text), length(text) FROM t),
g AS (SELECT doc_id, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, s FROM c)
SELECT doc_id, low::INT AS char_start, substr(text, low + 1, s - low) AS gap FROM g JOIN t USING (doc_id) WHERE low < s AND regexp_matches(substr(text, low + 1, s - low), '\\p{{L}}')""")
def unclaimed_verse_letters(spark, d):
    words = found(spark, d).where("number % 5 <> 0").select("doc_id", "char_start", "char_end")
    return verses.unclaimed_letters(words, chapters(spark, d).where("doc_id % 8 <> 7"), letter=r"\p{L}")
