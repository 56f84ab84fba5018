"""Lemma concordance and versification over a words table.

``words(word_id, doc_id, language, strong, homograph, prefixes, surface, morph, ref, char_start, char_end)`` with
``ref`` as ``Book.chapter.verse``; ``books(book, ordinal, name)``; ``verse_map(from_ref, part, to_ref, kind)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.aggregates import group_counts

MOST_OCCURRENCES = 2000


def ref_part(ref: Column, n: int) -> Column:
    """Part ``n`` of ``Book.chapter.verse[!half]``: 1 book, 2 chapter, 3 verse, 4 the half's letter (null if whole)."""
    if n == 4:
        return F.nullif(F.split_part(ref, F.lit("!"), F.lit(2)), F.lit(""))
    part = F.split_part(F.split_part(ref, F.lit("!"), F.lit(1)), F.lit("."), F.lit(n))
    return part if n == 1 else part.try_cast("int")


def parse_lemma(lemma: Column) -> Column:
    """struct(strong, homograph, prefixes) of a compound lemma such as ``c/l/1234 a``: the last part is the word."""
    parts = F.split(lemma, "/")
    last = F.trim(F.element_at(parts, -1))
    number = F.nullif(F.regexp_extract(last, r"^(\d+)", 1), F.lit(""))
    letter = F.nullif(F.regexp_extract(last, r"^\d+\s+([a-z])$", 1), F.lit(""))
    return F.struct(number.alias("strong"), letter.alias("homograph"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("prefixes"))


def lemma_filter(words: DataFrame, language: str, strong: str, homograph: str | None = None, book: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Words of a lemma.  ``homograph``: None takes all, "" those without a letter, a letter only its own."""
    out = words.where((F.col("language") == language) & (F.col("strong") == strong))
    if homograph is not None:
        out = out.where(F.col("homograph").isNull() if homograph == "" else F.col("homograph") == homograph)
    if book:
        out = out.where(ref_part(F.col("ref"), 1) == book)
    chapter = ref_part(F.col("ref"), 2)
    if first is not None:
        out = out.where(chapter >= first)
    if last is not None:
        out = out.where(chapter <= last)
    return out


def lemma_totals(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("occurrences"), F.count_distinct(ref_part(F.col("ref"), 1)).alias("books"))


def lemma_groups(hits: DataFrame) -> DataFrame:
    """Counts by surface, morph, prefixes, homograph and book from one scan; each group's counts sum to the hits."""
    return group_counts(hits.withColumn("book", ref_part(F.col("ref"), 1)), ["surface", "morph", "prefixes", "homograph", "book"])


def english_reference(hits: DataFrame, verse_map: DataFrame) -> DataFrame:
    """Hits with their mapped verse: ``unmapped`` (no scheme for the book), ``same``, ``full`` or ``partial``."""
    mapped = verse_map.select(F.col("from_ref").alias("ref"), "part", "to_ref", "kind")
    known = verse_map.select(ref_part(F.col("from_ref"), 1).alias("book")).distinct()
    joined = hits.withColumn("book", ref_part(F.col("ref"), 1)).join(mapped, "ref", "left").join(known.withColumn("known", F.lit(True)), "book", "left")
    status = F.when(F.col("to_ref").isNotNull(), F.when(F.col("part").isNotNull() | (F.col("kind") == "partial"), "partial").otherwise("full")).when(F.col("known"), "same").otherwise("unmapped")
    return joined.withColumn("status", status).withColumn("english", F.coalesce("to_ref", F.when(status == "same", F.col("ref")))).drop("known", "kind")


def fold_halves(rows: DataFrame, key: str) -> DataFrame:
    """A word mapped to both halves of a verse is one row with its verses in order."""
    rest = [c for c in rows.columns if c not in (key, "english", "part", "to_ref", "status")]
    return rows.groupBy(key, *rest).agg(F.array_join(F.sort_array(F.collect_set("english")), "; ").alias("english"), F.max("status").alias("status"))


def canonical_order(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Rows by book ordinal, chapter, verse, document, position and part; unknown books last."""
    ordinal = books.select("book", "ordinal")
    placed = rows.withColumn("book", ref_part(F.col("ref"), 1)).join(ordinal, "book", "left")
    return placed.orderBy(F.coalesce("ordinal", F.lit(999)), ref_part(F.col("ref"), 2), ref_part(F.col("ref"), 3), "doc_id", "char_start", ref_part(F.col("ref"), 4).asc_nulls_first())


def capped(rows: DataFrame, most: int = MOST_OCCURRENCES) -> DataFrame:
    """All rows, or none if there are more than ``most`` (decided inside the plan)."""
    total = rows.agg(F.count("*").alias("__total"))
    # One row.
    return rows.join(F.broadcast(total)).where(F.col("__total") <= most).drop("__total")


def misplaced_words(words: DataFrame, texts: DataFrame) -> DataFrame:
    """Words whose span doesn't quote their surface, runs past the text, or has no text."""
    joined = words.join(texts, "doc_id", "left")
    quoted = F.substring("canonical", F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    fault = F.when(F.col("canonical").isNull(), "no_text").when(F.col("char_end") > F.length("canonical"), "past_the_end").when(quoted != F.col("surface"), "other_word")
    return joined.withColumn("fault", fault).where("fault is not null").select("word_id", "doc_id", "fault")


def map_problems(verse_map: DataFrame, refs: DataFrame) -> DataFrame:
    """Faults of a verse map: a (from, part) with several targets, and targets that the edition lacks."""
    several = verse_map.groupBy("from_ref", "part").agg(F.count_distinct("to_ref").alias("n")).where("n > 1").select(F.lit("several_targets").alias("problem"), F.col("from_ref").alias("ref"))
    absent = verse_map.select(F.col("to_ref").alias("ref")).join(refs, "ref", "left_anti").select(F.lit("unknown_target").alias("problem"), "ref").distinct()
    return several.unionByName(absent)
