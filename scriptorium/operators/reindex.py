"""Re-chunking with re-anchoring, offset recovery, and plans for what has to be rebuilt."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from scriptorium.operators import spans
from scriptorium.session import bounded_batches

#: Fixed value: share of passages with dependents that may lose their place before a re-chunk is refused.
ORPHAN_SHARE = 0.005


class TooManyOrphans(ValueError):
    """A re-chunk would lose more dependents than allowed."""


def remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each old passage with its new one (``new_id``, the widest overlap) or the reason it has none.

    ``old`` and ``new`` are (passage_id, doc_id, char_start, char_end).
    """
    left = old.where("char_start is not null").select(F.col("passage_id").alias("l_id"), "doc_id", F.col("char_start").alias("l_start"), F.col("char_end").alias("l_end"))
    right = new.select(F.col("passage_id").alias("r_id"), "doc_id", F.col("char_start").alias("r_start"), F.col("char_end").alias("r_end"))
    best = spans.best_overlap(left, right).select(F.col("l_id").alias("passage_id"), F.col("r_id").alias("new_id"), "overlap")
    reason = F.when(F.col("char_start").isNull(), "no_offsets").when(F.col("new_id").isNull(), "no_overlap")
    return old.join(best, "passage_id", "left").withColumn("reason", reason).select("passage_id", "doc_id", "new_id", "overlap", "reason")


def orphans(mapping: DataFrame, dependents: dict[str, DataFrame]) -> DataFrame:
    """Old passages without a new one that something depends on: passage_id, reason, kind, dependents."""
    lost = mapping.where("new_id is null").select("passage_id", "reason")
    out = None
    for kind, rows in dependents.items():
        part = lost.join(rows.select("passage_id"), "passage_id").groupBy("passage_id", "reason").agg(F.count("*").alias("dependents")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def repoint(dependents: DataFrame, mapping: DataFrame, guard: list[str]) -> DataFrame:
    """Dependents under their new passage; of those that would meet there with equal ``guard`` columns one stays, an unmoved one first, then the smallest old id."""
    moved = dependents.join(mapping.where("new_id is not null").select("passage_id", "new_id"), "passage_id")
    rest = [c for c in dependents.columns if c not in guard and c != "passage_id"]
    order = F.struct((F.col("passage_id") != F.col("new_id")).alias("moved"), "passage_id")
    kept = moved.groupBy("new_id", *guard).agg(F.min_by(F.struct(*rest, F.lit(0)), order).alias("r"))
    return kept.select(F.col("new_id").alias("passage_id"), *guard, *[F.col(f"r.{c}").alias(c) for c in rest])


class Reindex(NamedTuple):
    mapping: DataFrame
    dependents: dict[str, DataFrame]
    orphans: DataFrame


def reindex(old: DataFrame, new: DataFrame, dependents: dict[str, tuple[DataFrame, list[str]]], most: float = ORPHAN_SHARE) -> Reindex:
    """Remap all passages and repoint all dependents (name: rows, guard columns); refused beforehand if orphans pass ``most``."""
    mapping = remap(old, new)
    lost = orphans(mapping, {k: rows for k, (rows, _) in dependents.items()})
    total = old.count()
    n = lost.select("passage_id").distinct().count()
    if n > most * total:
        raise TooManyOrphans(f"{n} of {total} passages would lose their dependents")
    return Reindex(mapping, {k: repoint(rows, mapping, guard) for k, (rows, guard) in dependents.items()}, lost)


def with_nodes(passages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Passages with the path of the deepest node around them, computed anew."""
    held = spans.deepest_containing(
        passages.where("char_start is not null").select(F.col("passage_id").alias("l_id"), "doc_id", F.col("char_start").alias("l_start"), F.col("char_end").alias("l_end")),
        nodes.select(F.col("path").alias("r_id"), "doc_id", F.col("node_start").alias("r_start"), F.col("node_end").alias("r_end"), "depth"),
    )
    return passages.drop("path").join(held.select(F.col("l_id").alias("passage_id"), F.col("r_id").alias("path")), "passage_id", "left")


def recover_offsets(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans of passages by their text: passage_id, doc_id, char_start, char_end (null where the text isn't found).

    A document's passages are matched in order of position; each search resumes
    after the last match and falls back to the document's beginning.  A document
    is one row with its text and its passages.
    """
    bounded_batches(docs.sparkSession)
    own = passages.select("doc_id", F.struct(F.col("position").isNull().alias("last"), "position", "passage_id", F.col("text").alias("wanted")).alias("p")).groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("own"))
    held = own.join(docs.select("doc_id", "text"), "doc_id", "left")
    return held.select("doc_id", F.explode(_recovered("text", "own")).alias("r")).select("r.passage_id", "doc_id", "r.char_start", "r.char_end")


_PLACES = Ty.ArrayType(Ty.StructType([Ty.StructField(name, Ty.LongType()) for name in ("passage_id", "char_start", "char_end")]))


@F.pandas_udf(_PLACES)
def _recovered(texts: pd.Series, passages: pd.Series) -> pd.Series:
    def places(text: str | None, own) -> list[dict]:
        out, cursor = [], 0
        for p in own:
            wanted, at = p["wanted"], -1
            if text is not None and wanted:
                at = text.find(wanted, cursor)
                at = text.find(wanted) if at < 0 else at
            if at >= 0:
                cursor = at + len(wanted)
            out.append({"passage_id": p["passage_id"], "char_start": at if at >= 0 else None, "char_end": cursor if at >= 0 else None})
        return out

    return pd.Series([places(t, own) for t, own in zip(texts, passages, strict=True)], dtype="object")


def documents_with_gaps(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents that have a text and a passage without offsets."""
    return passages.where("char_start is null or char_end is null").select("doc_id").distinct().join(texts.select("doc_id"), "doc_id", "left_semi")


def rebuild_candidates(texts: DataFrame, nodes: DataFrame, only_missing: bool = False) -> DataFrame:
    """Documents with a text, if asked only those without nodes."""
    return texts.select("doc_id").join(nodes.select("doc_id"), "doc_id", "left_anti") if only_missing else texts.select("doc_id")


def backfill_route(uri: Column, present: Column) -> Column:
    """How a document's text could be recovered: from its pack, not at all, at once, or by a slow parser."""
    return F.when(uri.isNull() | (uri == ""), "missing").when(uri.rlike(r"^[a-z][a-z0-9+.-]*://"), "pack").when(~present, "missing").when(F.lower(uri).rlike(r"\.(txt|md|html?|xml|epub)$"), "fast").otherwise("slow")


def stale_passages(passages: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Documents with a passage of a current chunker whose version is another one."""
    known = F.create_map(*[F.lit(x) for pair in versions.items() for x in pair])
    return passages.where(F.col("chunker").isin(list(versions)) & (F.col("chunker_version") != known[F.col("chunker")])).select("doc_id").distinct()


def stale_spans(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans made from another parser version than their document's text has now (null is a version of its own)."""
    now = texts.select("doc_id", F.col("parser_version").alias("now"))
    return rows.join(now, "doc_id").where(~F.col("parser_version").eqNullSafe(F.col("now"))).drop("now")


def version_drift(passages: DataFrame) -> DataFrame:
    return passages.groupBy("chunker", "chunker_version").agg(F.count("*").alias("n"))


def join_parts(parts: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Converted parts (doc_id, part, text) as whole texts, and their sections (doc_id, part, char_start, char_end) shifted to these.

    The parts of one document are one group, as its text is.
    """
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    texts = whole.select("doc_id", F.array_join("p.text", "").alias("text"))
    at = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.struct(F.col("p")[i]["part"].alias("part"), F.aggregate(F.slice("p", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x["text"])).alias("shift")))
    shifts = whole.select("doc_id", F.inline(at))
    moved = sections.join(shifts, ["doc_id", "part"])
    return texts, moved.withColumn("char_start", F.col("char_start") + F.col("shift")).withColumn("char_end", F.col("char_end") + F.col("shift")).drop("shift")
