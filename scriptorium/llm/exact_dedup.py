"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

Misra-Gries (``DataFrame.stat.freqItems``) proposes digests that may exceed a
share of the rows; an exact count verifies them.  The verified winners, at most
``1 / support`` rows, are broadcast and settle their groups map-side.  The
remaining digests, each of a bounded share, go through one ordinary shuffle.

Defined results: a null text counts as empty; empty texts are equal to each
other; a null ``doc_id`` sorts after every other; rows repeated with the same
``doc_id`` and text are copies too, of which exactly one stays; an empty table
gives an empty table; of input columns, only ``doc_id`` and ``text`` are read,
and an input column named like a result column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import SPACE, cut

#: Share of rows from which a digest is heavy; bounds the broadcast to 1 / SUPPORT rows.
SUPPORT = 0.001


def text_digest(text: Column) -> Column:
    """Binary SHA-256 of the text with each white-space run as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


def heavy_winners(keyed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Verified frequent digests of ``keyed(doc_id, digest)``: digest, keep_id, group_size, winners.

    ``winners`` counts the rows that carry ``keep_id``.  At most 1 / support rows.
    """
    short = lambda: F.xxhash64("digest")  # noqa: E731  freqItems compares values, which binaries don't offer
    probes = keyed.select(short().alias("probe")).stat.freqItems(["probe"], support)
    found = probes.first()[0] or []
    rows = keyed.count()
    return (
        keyed.where(short().isin([int(x) for x in found]) if found else F.lit(False))
        .groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
        .groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.min_by("n", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("winners"))
        .where(F.col("group_size") >= max(2, int(support * rows)))
    )


def exact_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of equal texts the smallest doc_id stays)."""
    keyed = cut(docs.select("doc_id", text_digest(F.col("text")).alias("digest")))
    winners = F.broadcast(cut(heavy_winners(keyed, support)))
    split = keyed.join(winners, "digest", "left")
    # Heavy digests: losers are settled where they are, the winner comes from the winners' table.
    losers = split.where("keep_id is not null and not (doc_id <=> keep_id)").select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest")
    chosen = winners.where("keep_id is not null").select(
        F.col("keep_id").alias("doc_id"), "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), "winners")).alias("nth"), "digest"
    ).select("doc_id", "keep_id", "group_size", (F.col("nth") == 1).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    light = (
        split.where("keep_id is null").select("doc_id", "digest")
        .withColumn("nth", F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last())))
        .select("doc_id", F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"), (F.col("nth") == 1).alias("kept"), "digest")
    )
    return light.unionByName(losers).unionByName(chosen).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.

    Texts don't travel unless they must: a drop list (ids and digests) is
    anti-joined; adaptive execution broadcasts it only if it measures small.
    """
    names = docs.columns
    groups = cut(exact_groups(docs, support))
    losers = groups.where("not kept and not (doc_id <=> keep_id)").select(F.col("doc_id").alias("__loser"), F.unhex("text_sha256").alias("__loser_digest"))
    ties = groups.where("not kept and doc_id <=> keep_id").select(F.col("doc_id").alias("__tied"), F.unhex("text_sha256").alias("__tied_digest"))
    keyed = docs.withColumn("__digest", text_digest(F.col("text")))
    kept = keyed.join(losers, F.col("doc_id").eqNullSafe(F.col("__loser")) & (F.col("__digest") == F.col("__loser_digest")), "left_anti")
    if ties.isEmpty():
        return kept.select(*names)
    # Rows repeated with one doc_id and text: one of each stays.
    same = F.col("doc_id").eqNullSafe(F.col("__tied")) & (F.col("__digest") == F.col("__tied_digest"))
    again = kept.join(ties.distinct(), same, "left_semi")
    first = again.withColumn("__nth", F.row_number().over(Window.partitionBy("__digest", "doc_id").orderBy("__digest"))).where("__nth = 1")
    return kept.join(ties.distinct(), same, "left_anti").unionByName(first.drop("__nth")).select(*names)
