"""The catalogue: lookups of stored rows, guarded writes, cascades, coverage, and entity resolution."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptorium.functions import text as T
from scriptorium.operators.relations import failed, run_checks, top_per_group

#: Similarity from which a name is the same entity, and from which it may be resolved to one.
SAME, RESOLVED = 0.95, 0.8
#: Fixed value: authors reported at most.
TOP_AUTHORS = 50


# --- lookups


def edges(rows: DataFrame, source: tuple[str, object] | None = None, target: tuple[str, object] | None = None, relation: str | None = None) -> DataFrame:
    """Edges by (kind, id) of either end and by relation."""
    for end, wanted in (("source", source), ("target", target)):
        if wanted is not None:
            rows = rows.where((F.col(f"{end}_kind") == wanted[0]) & (F.col(f"{end}_id") == F.lit(wanted[1])))
    return rows if relation is None else rows.where(F.col("relation") == relation)


def edges_of(rows: DataFrame, node: object) -> DataFrame:
    """Edges that start or end at a node."""
    return rows.where((F.col("source_id") == F.lit(node)) | (F.col("target_id") == F.lit(node)))


def newest(rows: DataFrame, order: str, key: str, k: int = 100) -> DataFrame:
    """The last ``k`` rows by ``order``, then key."""
    return rows.orderBy(F.desc(order), F.desc(key)).limit(k)


def of_type(rows: DataFrame, column: str, value: str, key: str, k: int = 100) -> DataFrame:
    """The first ``k`` rows of a type, by key."""
    return rows.where(F.col(column) == value).orderBy(key).limit(k)


def in_order(rows: DataFrame, column: str, value: object, order: list[str]) -> DataFrame:
    """Rows of one owner (a document's passages, a claim's anchors, a span's links) in their order."""
    return rows.where(F.col(column) == F.lit(value)).orderBy(*order)


def mentions(rows: DataFrame, entity: object, source: str | None = None, confidence: float | None = None) -> DataFrame:
    """Mentions of an entity, from a source and of a confidence if asked."""
    rows = rows.where(F.col("entity_id") == F.lit(entity))
    rows = rows if source is None else rows.where(F.col("source") == source)
    return rows if confidence is None else rows.where(F.col("confidence") >= confidence)


def by_source(documents: DataFrame, passages: DataFrame, source: str | None = None, pattern: str | None = None) -> DataFrame:
    """Documents of a source, or whose source holds a text, with their passage counts."""
    chosen = documents.where(F.col("source") == source) if source is not None else documents.where(F.contains(F.lower("source"), F.lit((pattern or "").lower())))
    counts = passages.groupBy("doc_id").agg(F.count("*").alias("n_passages"))
    return chosen.join(counts, "doc_id", "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))


def names_of(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, name): canonical names and aliases, each once."""
    return entities.select("entity_id", "name").union(aliases.select("entity_id", F.col("alias").alias("name"))).distinct()


def events_between(events: DataFrame, actors: DataFrame, start: Column, end: Column, kind: str | None = None, actor: object = None) -> DataFrame:
    """Passages of events that overlap a period (an open end counts as its start), of a type and with an actor if asked."""
    begins = (F.col("end") >= start) | (F.col("end").isNull() & (F.col("start") >= start))
    chosen = events.where(begins & (F.col("start") <= end))
    chosen = chosen if kind is None else chosen.where(F.col("event_type") == kind)
    if actor is not None:
        chosen = chosen.join(actors.where(F.col("entity_id") == F.lit(actor)), "event_id", "left_semi")
    return chosen.select("passage_id").distinct()


def records_of(records: DataFrame, kind: str, holds: Column | None = None, passages: list | None = None, k: int = 100) -> DataFrame:
    """Extracted records of a type that hold some data, of some passages if asked (of none: none), the first ``k`` by passage and number."""
    rows = records.where(F.col("record_type") == kind)
    rows = rows if holds is None else rows.where(holds)
    rows = rows if passages is None else rows.where(F.col("passage_id").isin(passages) if passages else F.lit(False))
    return rows.orderBy("passage_id", "n").limit(k)


def passages_with(records: DataFrame, kind: str, holds: Column | None = None) -> DataFrame:
    """Passages that have a record of a type (holding some data, if asked)."""
    rows = records.where(F.col("record_type") == kind)
    return (rows if holds is None else rows.where(holds)).select("passage_id").distinct()


def select_for_extraction(passages: DataFrame, nodes: DataFrame, dated_only: bool, k: int) -> DataFrame:
    """The first ``k`` passages in document order, of dated nodes only if asked, with their estimated tokens."""
    rows = passages.join(nodes.where("date_start is not null").select("doc_id", "path"), ["doc_id", "path"], "left_semi") if dated_only else passages
    return rows.orderBy("doc_id", "position").limit(k).withColumn("tokens", T.approx_tokens(F.col("text")))


# --- coverage


def authors(documents: DataFrame, k: int = TOP_AUTHORS) -> DataFrame:
    """Documents per author: ``metadata`` has one under "author", or an array under "authors"."""
    one = documents.select(F.get_json_object("metadata", "$.author").alias("author")).where("author is not null")
    raw = F.get_json_object("metadata", "$.authors")
    many = documents.where(F.startswith(F.ltrim(raw), F.lit("["))).select(F.explode(F.from_json(raw, "array<string>")).alias("author"))
    return one.unionByName(many).groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(k)


def embedding_coverage(passages: DataFrame, embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    """One row: passages, how many are embedded by the model, its vectors of another length, and vectors of other models."""
    own = F.col("model") == model
    counted = embeddings.agg(
        F.count_distinct(F.when(own, F.col("passage_id"))).alias("embedded"), F.count_if(own & (F.size("embedding") != dim)).alias("wrong_dim"), F.count_if(~own).alias("foreign")
    )
    return passages.agg(F.count("*").alias("total")).crossJoin(counted)  # two single rows


def coverage_by_type(passages: DataFrame, documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per document type: passages, and how many have an embedding."""
    has = embeddings.select("passage_id").distinct().withColumn("has", F.lit(1))
    joined = passages.join(documents.select("doc_id", "document_type"), "doc_id").join(has, "passage_id", "left")
    return joined.groupBy("document_type").agg(F.count("*").alias("total"), F.count("has").alias("embedded"))


def known_books(words: DataFrame, ordinals: DataFrame, language: str) -> DataFrame:
    """Books in which words of a language are, with their least ordinal (999 if unknown), in that order."""
    books = words.where(F.col("language") == language).select(F.split_part("ref", F.lit("."), F.lit(1)).alias("book"))
    return books.distinct().join(ordinals, "book", "left").groupBy("book").agg(F.min(F.coalesce("ordinal", F.lit(999))).alias("ordinal")).orderBy("ordinal", "book")


# --- writes


@F.pandas_udf(StringType())
def shallow_merge(old: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON objects merged at their top level, the right one winning (null stays null)."""
    read = lambda x: json.loads(x) if x else {}
    return pd.Series([json.dumps(read(a) | read(b), ensure_ascii=False, sort_keys=True) for a, b in zip(old, patch, strict=True)], dtype="object")


def update_attributes(rows: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with the JSON ``column`` shallow-merged with their patch, if they have one."""
    joined = rows.join(patches.select(key, F.col(column).alias("__patch")), key, "left")
    return joined.withColumn(column, F.when(F.col("__patch").isNull(), F.col(column)).otherwise(shallow_merge(column, "__patch"))).drop("__patch")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str, through: dict[str, tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """Every table without the rows of the keys in ``gone``.

    ``through`` names, for a table without ``key``, the column it has and the table that leads from this to ``key``.
    """
    out = {}
    for name, rows in tables.items():
        if key in rows.columns:
            out[name] = rows.join(gone.select(key), key, "left_anti")
        else:
            column, by = (through or {})[name]
            lost = tables[by].join(gone.select(key), key, "left_semi").select(column).distinct()
            out[name] = rows.join(lost, column, "left_anti")
    return out


def purge_model(embeddings: DataFrame, model: str, active: str) -> DataFrame:
    """Embeddings without those of a model, which mustn't be the active one."""
    if model == active:
        raise ValueError(f"{model} is the active model")
    return embeddings.where(F.col("model") != model)


def store_embeddings(embeddings: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """Embeddings with new vectors in place of those of the same passage and model; vectors of another length are refused."""
    if not new.where(F.size("embedding") != dim).isEmpty():
        raise ValueError(f"a vector doesn't have {dim} components")
    return embeddings.join(new.select("passage_id", "model"), ["passage_id", "model"], "left_anti").unionByName(new)


def resolve_spans(requests: DataFrame, stored: DataFrame, docs: DataFrame) -> DataFrame:
    """Get or create: per requested (doc_id, start, end) its span_id, its text and whether it is new; spans outside the text are left out."""
    placed = requests.select("doc_id", "start", "end").distinct().join(docs.select("doc_id", "text"), "doc_id").where("0 <= start and start < end and end <= length(text)")
    # Cut before the next join, so that no span takes its whole text along.
    asked = placed.select("doc_id", "start", "end", T.slice_span(F.col("text"), F.col("start"), F.col("end")).alias("span_text"))
    known = stored.select("doc_id", "start", "end", "span_id")
    made = F.sha2(F.concat_ws("/", "doc_id", "start", "end"), 256)
    joined = asked.join(known, ["doc_id", "start", "end"], "left")
    return joined.select(F.coalesce("span_id", made).alias("span_id"), "doc_id", "start", "end", "span_text", F.col("span_id").isNull().alias("created"))


def guarded_upsert(rows: DataFrame, drafts: DataFrame, keys: list[str], stamp: str = "updated_at") -> DataFrame:
    """Outcome per draft: inserted, updated (its ``expected`` stamp is the stored one) or refused."""
    held = rows.select(*keys, F.col(stamp).alias("__held"), F.lit(True).alias("__known"))
    outcome = F.when(F.col("__known").isNull(), "inserted").when(F.col("expected").eqNullSafe(F.col("__held")), "updated").otherwise("refused")
    return drafts.join(held, keys, "left").withColumn("outcome", outcome).drop("__held", "__known")


def claim_edge_faults(drafts: DataFrame) -> DataFrame:
    """Claim edges that are listed twice or lead back to their own claim."""
    keys = ["source_id", "target_id", "relation"]
    subject = F.concat_ws(":", *keys)
    twice = drafts.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return run_checks([failed("duplicate", twice, subject, F.col("n")), failed("self", drafts.where("source_id = target_id").distinct(), subject, F.col("relation"))])


# --- entities


def name_matches(drafts: DataFrame, names: DataFrame, least: float = 0.3) -> DataFrame:
    """(draft_id, entity_id, score): best trigram similarity of a draft's name with any name of an entity, from ``least`` on.

    Pairs meet through shared trigrams, so no draft is compared with all names.
    """
    grams = lambda df, key, name: df.withColumn(name, T.trigrams(F.lower(name))).select(key, name, F.size(name).alias(f"{name}_n"), F.explode(name).alias("gram"))
    own = grams(names.select("entity_id", F.col("name").alias("known")).distinct(), "entity_id", "known")
    # A pair shares at least ``least`` of the larger set, so sizes prune it before its trigrams are counted.
    near = (F.col("name_n") >= least * F.col("known_n")) & (F.col("known_n") >= least * F.col("name_n"))
    met = grams(drafts.select("draft_id", "name"), "draft_id", "name").join(own, "gram").where(near)
    shared = met.groupBy("draft_id", "name_n", "entity_id", "known", "known_n").agg(F.count("*").alias("both"))
    scored = shared.withColumn("score", F.col("both") / (F.col("name_n") + F.col("known_n") - F.col("both"))).where(F.col("score") >= least)
    return scored.groupBy("draft_id", "entity_id").agg(F.max("score").alias("score"))


def resolve_entities(drafts: DataFrame, names: DataFrame, least: float = RESOLVED) -> DataFrame:
    """Per draft the entity that it means: the best match from ``least`` on, if no other is as good; else null."""
    best = top_per_group(name_matches(drafts, names, least), ["draft_id"], [F.desc("score"), F.col("entity_id")], 2)
    sure = best.groupBy("draft_id").agg(F.min_by("entity_id", "rank").alias("entity_id"), F.max("score").alias("score"), F.count_if(F.col("rank") == 2).alias("second"), F.min("score").alias("low"))
    chosen = sure.where("second = 0 or low < score").select("draft_id", "entity_id", "score")
    return drafts.select("draft_id").join(chosen, "draft_id", "left")


def upsert_entities(drafts: DataFrame, names: DataFrame, same: float = SAME) -> DataFrame:
    """Per draft: the entity that it updates (a match above ``same``) or, new, the draft's own id."""
    best = top_per_group(name_matches(drafts, names, same).where(F.col("score") > same), ["draft_id"], [F.desc("score"), F.col("entity_id")], 1)
    joined = drafts.join(best.select("draft_id", F.col("entity_id").alias("found")), "draft_id", "left")
    return joined.select("draft_id", "name", F.coalesce("found", F.concat(F.lit("new:"), "draft_id")).alias("entity_id"), F.col("found").isNull().alias("created"))
