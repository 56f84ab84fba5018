"""The corpus report: 22 invariants over passages, texts, nodes, words and extractions, each with its offenders.

Checks of spans read each text once, by document, however many passages quote it.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from scriptorium.functions import tokens as K
from scriptorium.session import bounded_batches, stored

#: The checks and their severities.
CHECKS = {
    "passage_span_well_formed": "critical", "passage_has_offsets": "warning", "passage_offsets_recoverable_by_reparse": "warning", "passage_offsets_need_a_pack_reingest": "warning",
    "document_has_canonical_text": "warning", "document_text_needs_a_pack_reingest": "warning", "passage_is_not_empty": "warning", "passage_is_not_oversized": "warning",
    "current_chunkers_are_not_emitting_oversized_passages": "critical", "passage_is_embedded": "warning", "passage_is_indexed_for_keywords": "warning", "node_sits_inside_its_parent": "critical",
    "passage_node_is_in_the_same_document": "critical", "extraction_evidence_is_anchored": "critical", "word_span_quotes_its_word": "critical", "word_span_is_inside_its_document": "critical",
    "word_has_document_text_to_address": "warning", "extraction_records_are_materialized": "warning", "passage_text_matches_its_span": "critical", "passage_span_within_the_text": "critical",
    "node_span_within_the_text": "critical", "passages_on_current_chunker_versions": "info",
}
OVERSIZED = 1200


class Corpus(NamedTuple):
    """The tables of a corpus; of those that are None, the checks are skipped, not passed."""

    passages: DataFrame  # passage_id, doc_id, char_start, char_end, text, node_id, chunker, chunker_version
    documents: DataFrame  # doc_id, source
    texts: DataFrame  # doc_id, text
    nodes: DataFrame | None = None  # node_id, doc_id, parent_id, char_start, char_end
    embedded: DataFrame | None = None  # passage_id
    indexed: DataFrame | None = None  # passage_id
    words: DataFrame | None = None  # word_id, doc_id, char_start, char_end, surface
    extractions: DataFrame | None = None  # extraction_id, status, records (a JSON array)
    records: DataFrame | None = None  # record_id, extraction_id, passage_id, evidence_start, evidence_end


def is_uri(source: Column) -> Column:
    """Whether a source is an address rather than a path of a file."""
    return F.contains(source, F.lit("://")) | (F.contains(source, F.lit(":")) & ~F.startswith(source, F.lit("/")))


#: Bytes from which a quoted text travels as its SHA-256 (as many hexadecimal digits, so that no shorter text equals one).
DIGEST_FROM = 64


def _mark(quoted: Column) -> Column:
    return F.when(F.octet_length(quoted) < DIGEST_FROM, quoted).otherwise(F.sha2(quoted.cast("binary"), 256))


def _mark_of(text: str) -> str:
    data = text.encode()
    return text if len(data) < DIGEST_FROM else hashlib.sha256(data).hexdigest()


_SPANS = Ty.ArrayType(Ty.StructType([Ty.StructField("kind", Ty.StringType()), Ty.StructField("id", Ty.StringType()), Ty.StructField("fault", Ty.StringType())]))


@F.pandas_udf(_SPANS)
def _span_faults(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Spans (kind, id, start, end, quoted) that run past their document's text, or don't quote it (quoted: the text's mark); of nodes only the end is held against it."""

    def faults(text: str, own) -> list[dict]:
        out = []
        for s in own:
            past = s["end"] > len(text) or (s["start"] < 0 and s["kind"] != "node")
            # A word past the end quotes nothing either; a passage past the end has one fault.
            if past:
                out.append({"kind": s["kind"], "id": s["id"], "fault": "past"})
            if s["kind"] != "node" and not (past and s["kind"] == "passage") and (_mark_of(text[max(0, s["start"]) : max(0, s["end"])]) if s["start"] >= 0 else None) != s["quoted"]:
                out.append({"kind": s["kind"], "id": s["id"], "fault": "differs"})
        return out

    return pd.Series([faults(t, s) for t, s in zip(texts, spans, strict=True)], dtype="object")


def span_faults(c: Corpus) -> DataFrame:
    """(check, id): spans of passages, words and nodes held against their document's text."""
    span = lambda df, kind, key, quoted: df.where("char_start is not null and char_end is not null").select("doc_id", F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col("char_start").cast("int").alias("start"), F.col("char_end").cast("int").alias("end"), _mark(quoted).alias("quoted")).alias("span"))
    spans = span(c.passages, "passage", "passage_id", F.col("text"))
    if c.nodes is not None:
        spans = spans.union(span(c.nodes, "node", "node_id", F.lit(None).cast("string")))
    if c.words is not None:
        spans = spans.union(span(c.words, "word", "word_id", F.col("surface")))
    # One row a document: as many spans as it has, without what they quote, and its text once.
    bounded_batches(c.passages.sparkSession)
    own = spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    found = own.join(c.texts.where("text is not null"), "doc_id").select(F.explode(_span_faults("text", "spans")).alias("f")).select("f.*")
    names = {("passage", "past"): "passage_span_within_the_text", ("passage", "differs"): "passage_text_matches_its_span", ("node", "past"): "node_span_within_the_text", ("word", "past"): "word_span_is_inside_its_document", ("word", "differs"): "word_span_quotes_its_word"}
    check = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("fault") == f), name) for (k, f), name in names.items()])
    return found.select(check.alias("check"), "id")


def offenders(c: Corpus, versions: dict[str, str]) -> DataFrame:
    """(check, id) of everything that breaks a check; ``versions`` are those of the chunkers in use."""
    found = lambda rows, check, key: rows.select(F.lit(check).alias("check"), key.cast("string").alias("id"))
    p, held = F.col("passage_id"), c.texts.where("text is not null").select("doc_id")
    # What is asked of a passage alone or of its document's facts is asked in one pass; its text stays where it is.
    facts = c.documents.select("doc_id", "source").join(held.withColumn("has_text", F.lit(True)), "doc_id", "full")
    sized = c.passages.select("passage_id", "doc_id", "char_start", "char_end", "chunker", "chunker_version", (F.trim("text") == "").alias("blank"), (K.by_bytes(F.col("text")) > OVERSIZED).alias("oversized"), F.length("text").alias("n_chars"))
    rows = sized.join(facts, "doc_id", "left")
    slot = F.col("char_start").isNull() | F.col("char_end").isNull()
    textless = F.col("has_text").isNull() & F.col("source").isNotNull()
    uri = is_uri(F.col("source"))
    expected = F.coalesce(*[F.when(F.col("chunker") == k, F.lit(v)) for k, v in versions.items()]) if versions else F.lit(None).cast("string")
    in_use = F.coalesce(F.col("chunker_version") == expected, F.lit(False))
    emitted = F.format_string("%s %s: %d chars", "chunker", "chunker_version", "n_chars")
    tests = [
        ("passage_span_well_formed", F.col("char_end") < F.col("char_start"), p),
        ("passage_has_offsets", slot & F.col("has_text"), p),
        ("passage_offsets_recoverable_by_reparse", slot & textless & ~uri, p),
        ("passage_offsets_need_a_pack_reingest", slot & textless & uri, p),
        ("passage_is_not_empty", F.col("blank"), p),
        ("passage_is_not_oversized", F.col("oversized") & ~in_use, p),
        ("current_chunkers_are_not_emitting_oversized_passages", F.col("oversized") & in_use, emitted),
        ("passages_on_current_chunker_versions", expected.isNotNull() & ~F.col("chunker_version").eqNullSafe(expected), p),
    ]
    broken = F.filter(F.array(*[F.when(test, F.struct(F.lit(check).alias("check"), key.cast("string").alias("id"))) for check, test, key in tests]), lambda x: x.isNotNull())
    lost = rows.where(textless).select("doc_id", uri.alias("uri")).distinct()
    out = [
        rows.select(F.explode(broken).alias("b")).select("b.check", "b.id"),
        lost.select(F.when(F.col("uri"), "document_text_needs_a_pack_reingest").otherwise("document_has_canonical_text").alias("check"), F.col("doc_id").cast("string").alias("id")),
        span_faults(c),
    ]
    if c.embedded is not None:
        out.append(found(c.passages.select("passage_id").join(c.embedded, "passage_id", "left_anti"), "passage_is_embedded", p))
    if c.indexed is not None:
        out.append(found(c.passages.select("passage_id").join(c.indexed, "passage_id", "left_anti"), "passage_is_indexed_for_keywords", p))
    if c.nodes is not None:
        above = c.nodes.select(F.col("node_id").alias("parent_id"), F.col("char_start").alias("low"), F.col("char_end").alias("high"))
        out.append(found(c.nodes.join(above, "parent_id").where("char_start < low or char_end > high"), "node_sits_inside_its_parent", F.col("node_id")))
        placed = c.nodes.select("node_id", F.col("doc_id").alias("node_doc"))
        out.append(found(c.passages.select("passage_id", "doc_id", "node_id").join(placed, "node_id").where("node_doc <> doc_id"), "passage_node_is_in_the_same_document", p))
    if c.words is not None:
        out.append(found(c.words.select("doc_id").distinct().join(held, "doc_id", "left_anti"), "word_has_document_text_to_address", F.col("doc_id")))
    if c.records is not None:
        sized = c.passages.select("passage_id", F.length("text").alias("n"))
        loose = F.col("evidence_start").isNull() | F.col("evidence_end").isNull() | (F.col("evidence_start") < 0) | (F.col("evidence_end") > F.col("n")) | (F.col("evidence_end") <= F.col("evidence_start"))
        out.append(found(c.records.join(sized, "passage_id").where(loose), "extraction_evidence_is_anchored", F.col("record_id")))
    if c.records is not None and c.extractions is not None:
        reported = c.extractions.where((F.col("status") == "ok") & (F.json_array_length("records") > 0))
        out.append(found(reported.join(c.records.select("extraction_id").distinct(), "extraction_id", "left_anti"), "extraction_records_are_materialized", F.col("extraction_id")))
    all_ = out[0]
    for rows in out[1:]:
        all_ = all_.unionByName(rows)
    return all_


def skipped(c: Corpus) -> list[str]:
    """The checks for which a table is missing."""
    needs = {
        "passage_is_embedded": c.embedded, "passage_is_indexed_for_keywords": c.indexed, "node_sits_inside_its_parent": c.nodes, "passage_node_is_in_the_same_document": c.nodes, "node_span_within_the_text": c.nodes,
        "word_span_quotes_its_word": c.words, "word_span_is_inside_its_document": c.words, "word_has_document_text_to_address": c.words, "extraction_evidence_is_anchored": c.records,
        "extraction_records_are_materialized": None if c.records is None else c.extractions,
    }
    return [check for check, needed in needs.items() if needed is None]


def report(c: Corpus, versions: dict[str, str], samples: int = 5) -> DataFrame:
    """One row a check: check, severity (info if it was skipped), skipped, n offenders, the smallest ``samples`` ids, and place in the report: failed before passed, then by severity and name."""
    spark = c.passages.sparkSession
    left_out = set(skipped(c))
    listed = spark.createDataFrame([(name, "info" if name in left_out else severity, name in left_out) for name, severity in CHECKS.items()], "check string, severity string, skipped boolean")
    found = stored(offenders(c, versions))  # read twice
    least = F.row_number().over(Window.partitionBy("check").orderBy("id"))
    # A check's smallest ids: ranks are cut off before the shuffle.
    few = found.withColumn("nth", least).where(F.col("nth") <= samples).groupBy("check").agg(F.sort_array(F.collect_list("id")).alias("samples"))
    counted = found.groupBy("check").agg(F.count("*").alias("n"))
    rows = listed.join(F.broadcast(counted), "check", "left").join(F.broadcast(few), "check", "left")
    rows = rows.select("check", "severity", "skipped", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.array_join(F.coalesce("samples", F.expr("cast(array() as array<string>)")), ",").alias("samples"))
    order = F.struct(F.col("n") == 0, F.array_position(F.array(*map(F.lit, ("critical", "warning", "info"))), F.col("severity")), "check")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(order)))  # as many rows as there are checks
