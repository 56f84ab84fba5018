"""Filters, semi- and anti-joins, upserts, set operations and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import jsons

FILTER_KEYS = frozenset("document_types date_start date_end language author_names recipient_names source metadata mentions_all extensions".split())


def validate_filters(filters: dict) -> None:
    """Unknown keys are an error, never ignored."""
    unknown = set(filters) - FILTER_KEYS
    if unknown:
        raise ValueError(f"unknown filter keys: {sorted(unknown)}")


def candidates(docs: DataFrame, filters: dict, mentions: DataFrame | None = None, extensions: dict[str, DataFrame] | None = None, any_extension: bool = False) -> DataFrame:
    """Ids of documents that satisfy every filter; extensions are (doc_id) frames joined by AND, or OR."""
    validate_filters(filters)
    conditions: list[Column] = []
    if filters.get("document_types"):
        conditions.append(F.col("document_type").isin(filters["document_types"]))
    if filters.get("date_start"):
        conditions.append(F.col("date_start") >= F.lit(filters["date_start"]))
    if filters.get("date_end"):
        conditions.append(F.col("date_end") <= F.lit(filters["date_end"]))
    if filters.get("language"):
        conditions.append(F.col("lang") == filters["language"])
    if filters.get("source"):
        conditions.append(F.contains(F.lower("source"), F.lit(filters["source"].lower())))
    for role in ("author", "recipient"):
        names = filters.get(f"{role}_names")
        if names is not None:
            hit = [F.contains(F.lower(role), F.lit(n.lower())) for n in names]
            conditions.append(reduce(lambda a, b: a | b, hit, F.lit(False)))
    if filters.get("metadata"):
        conditions.append(jsons.contains(F.col("metadata"), filters["metadata"]))
    out = docs.where(reduce(lambda a, b: a & b, conditions, F.lit(True))).select("doc_id")
    if filters.get("mentions_all"):
        out = out.join(mentions_all(mentions, filters["mentions_all"]), "doc_id", "left_semi")
    chosen = [extensions[e] for e in filters.get("extensions", [])] if extensions else []
    if chosen and any_extension:
        out = out.join(reduce(DataFrame.union, [c.select("doc_id") for c in chosen]).distinct(), "doc_id", "left_semi")
    else:
        for c in chosen:
            out = out.join(c, "doc_id", "left_semi")
    return out.distinct()


def mentions_all(mentions: DataFrame, entities: list) -> DataFrame:
    """Documents of ``mentions(doc_id, entity)`` that mention every one of the entities: one shuffle."""
    wanted = sorted(set(entities))
    return mentions.where(F.col("entity").isin(wanted)).groupBy("doc_id").agg(F.count_distinct("entity").alias("n")).where(F.col("n") == len(wanted)).select("doc_id")


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert as a view: of rows with equal keys the last in ``order`` (an aggregate, so it combines map-side)."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-ignore as a view: of rows with equal keys the first in ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest])


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete-then-insert: old rows whose key isn't replaced, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def update_column(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Bulk update by key; null is a legal new value."""
    new = updates.select(key, F.col(column).alias("__new"), F.lit(True).alias("__given"))
    value = F.when(F.col("__given"), F.col("__new")).otherwise(F.col(column))
    return rows.join(new, key, "left").withColumn(column, value).drop("__new", "__given")


def content_dedup(docs: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """New documents by (content hash, source): the smallest id of each, none that ``store(content_hash, source)`` holds."""
    hashed = docs.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    first = keep_first(hashed, ["content_hash", "source"], ["doc_id"])
    return first if store is None else first.join(store, ["content_hash", "source"], "left_anti")


def ordered_get(rows: DataFrame, ids: list[int], key: str) -> DataFrame:
    """Rows by an id list in the order asked for; missing ids are left out."""
    asked = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"ord int, {key} long")
    # The side broadcast is the caller's own list.
    return rows.join(F.broadcast(asked), key).orderBy("ord", key)


def not_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).distinct()


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in which two frames differ, with the side: empty if they are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def failed(check: str, rows: DataFrame, key: Column, detail: Column) -> DataFrame:
    """One row per violation, in the shape all checks share."""
    return rows.select(F.lit(check).alias("check"), key.cast("string").alias("id"), detail.cast("string").alias("detail"))


def run_checks(checks: list[DataFrame]) -> DataFrame:
    """All checks' violations together."""
    return reduce(DataFrame.unionByName, checks)


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group (Spark prunes to k per task before the shuffle)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", nth).where(F.col("rank") <= k)
