"""Corpus integrity checks and claim audits, one frame of violations each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.relations import failed, run_checks

OVERSIZED_TOKENS = 1200


def passage_checks(passages: DataFrame, texts: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
    """Span, text, size and embedding checks of ``passages(passage_id, doc_id, char_start, char_end, text)``.

    ``texts(doc_id, canonical)``: canonical text travels once, by document.
    """
    key = F.col("passage_id")
    span = F.concat_ws("-", "char_start", "char_end")
    joined = passages.join(texts, "doc_id", "left")
    known = joined.where("canonical is not null and char_start is not null")
    out = [
        failed("passage_span_well_formed", passages.where("char_end < char_start"), key, span),
        failed("passage_has_offsets", joined.where("canonical is not null and char_start is null"), key, F.col("doc_id")),
        failed("document_has_canonical_text", joined.where("canonical is null"), key, F.col("doc_id")),
        failed("passage_is_not_empty", passages.where(F.trim(F.coalesce("text", F.lit(""))) == ""), key, F.col("doc_id")),
        failed("passage_is_not_oversized", passages.where(T.approx_tokens(F.col("text")) > OVERSIZED_TOKENS), key, F.length("text")),
        failed("passage_span_within_the_text", known.where("char_end > length(canonical)"), key, span),
        failed("passage_text_matches_its_span", known.where("char_end <= length(canonical) and char_end >= char_start").where(T.slice_span(F.col("canonical"), F.col("char_start"), F.col("char_end")) != F.col("text")), key, span),
    ]
    if embedded is not None:
        out.append(failed("passage_is_embedded", passages.join(embedded, "passage_id", "left_anti"), key, F.col("doc_id")))
    return run_checks(out)


def node_checks(nodes: DataFrame, lengths: DataFrame) -> DataFrame:
    """A node lies inside its parent and inside its text: ``nodes(doc_id, path, char_start, char_end)``."""
    parent = nodes.select("doc_id", F.col("path").alias("parent"), F.col("char_start").alias("p_start"), F.col("char_end").alias("p_end"))
    child = nodes.withColumn("parent", F.regexp_replace("path", r"\.[^.]*$", "")).where("path like '%.%'")
    key = F.concat_ws(":", "doc_id", "path")
    return run_checks([
        failed("node_sits_inside_its_parent", child.join(parent, ["doc_id", "parent"]).where("char_start < p_start or char_end > p_end"), key, F.col("parent")),
        failed("node_span_within_the_text", nodes.join(lengths, "doc_id").where("char_end > n_chars"), key, F.col("char_end")),
    ])


def claim_audit(claims: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Three rules over ``claims(ref, kind, status, public_ready)``, ``edges(source, target, relation)``, ``anchors(ref, role, person)``."""
    asserted = anchors.where("role = 'asserts'").select("ref").distinct()
    attributed = anchors.where("role = 'asserts' and person is not null").select("ref").distinct()
    opposed = claims.where("kind = 'opposition'").join(asserted, "ref", "left_anti")
    rebuttals = edges.where("relation = 'rebuts'").join(attributed.withColumnRenamed("ref", "target"), "target", "left_anti")
    unready = claims.where("public_ready and status = 'open'")
    return run_checks([
        failed("opposition_unanchored", opposed, F.col("ref"), F.col("kind")),
        failed("rebuttal_unattributed", rebuttals, F.col("source"), F.col("target")),
        failed("open_claim_public", unready, F.col("ref"), F.col("status")),
    ])


def license_quota(quotes: DataFrame, most: int = 1000) -> DataFrame:
    """Documents quoted beyond ``most`` characters, with the works that quote them."""
    return quotes.groupBy("doc_id").agg(F.sum(F.length("quote")).alias("quoted"), F.sort_array(F.collect_set("work")).alias("works")).where(F.col("quoted") > most)


def severities(violations: DataFrame, policy: dict[str, str], default: str = "error") -> DataFrame:
    """Violations with their severity under a policy; ``allow`` drops them, an unknown rule gets the default."""
    if not policy:
        return violations.withColumn("severity", F.lit(default))
    table = F.create_map(*[F.lit(x) for pair in policy.items() for x in pair])
    return violations.withColumn("severity", F.coalesce(F.try_element_at(table, F.col("check")), F.lit(default))).where("severity <> 'allow'")


def blockers(violations: DataFrame, waivers: DataFrame) -> DataFrame:
    """Errors that no waiver (of the rule, for the subject or for all) covers."""
    errors = violations.where("severity = 'error'")
    covering = waivers.select(F.col("check").alias("w_check"), F.col("subject").alias("w_subject"))
    return errors.join(covering, (F.col("check") == F.col("w_check")) & (F.col("w_subject").isNull() | (F.col("w_subject") == F.col("id"))), "left_anti")
