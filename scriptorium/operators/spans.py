"""Span operators over half-open code-point intervals: overlap, containment, best fit, gaps.

Interval joins are equi-joins on (document, bucket) with the interval test as
residual: an interval is replicated to the fixed-width buckets it touches, and a
pair is kept only in the first bucket both touch.  So nothing is a nested loop, no
pair appears twice, and long documents spread over many keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def overlap_join(left: DataFrame, right: DataFrame, width: int = BUCKET) -> DataFrame:
    """All pairs with ``left.start < right.end and left.end > right.start`` in one document.

    ``left(l_id, doc_id, l_start, l_end)``, ``right(r_id, doc_id, r_start, r_end)``.
    """

    def spread(df: DataFrame, x: str) -> DataFrame:
        first = F.floor(F.col(f"{x}_start") / width).cast("long")
        last = F.floor((F.col(f"{x}_end") - 1) / width).cast("long")
        return df.where(f"{x}_end > {x}_start").withColumn(f"{x}_first", first).withColumn("bucket", F.explode(F.sequence(first, last)))

    joined = spread(left, "l").join(spread(right, "r"), ["doc_id", "bucket"])
    return joined.where("l_start < r_end and l_end > r_start and bucket = greatest(l_first, r_first)").drop("bucket", "l_first", "r_first")


def containment_join(inner: DataFrame, outer: DataFrame, width: int = BUCKET) -> DataFrame:
    """Pairs in which ``outer`` (r) encloses ``inner`` (l): an equi-join on the bucket of the inner start."""
    inner = inner.withColumn("bucket", F.floor(F.col("l_start") / width).cast("long"))
    first, last = F.floor(F.col("r_start") / width).cast("long"), F.floor(F.col("r_end") / width).cast("long")
    outer = outer.withColumn("bucket", F.explode(F.sequence(first, last)))
    return inner.join(outer, ["doc_id", "bucket"]).where("r_start <= l_start and l_end <= r_end").drop("bucket")


def best_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per left span the right span with the widest overlap, ties to the earlier start, then id."""
    pairs = overlap_join(left, right).withColumn("overlap", F.least("l_end", "r_end") - F.greatest("l_start", "r_start"))
    best = F.min(F.struct((-F.col("overlap")).alias("o"), "r_start", "r_id", "r_end")).alias("b")
    return pairs.groupBy("l_id", "doc_id", "l_start", "l_end").agg(best).select("l_id", "doc_id", F.col("b.r_id").alias("r_id"), (-F.col("b.o")).alias("overlap"))


def deepest_containing(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per span the deepest node around it: ties to the earlier start, then id.  ``nodes`` carry ``depth``."""
    pairs = containment_join(spans, nodes)
    best = F.min(F.struct((-F.col("depth")).alias("d"), F.col("r_start"), F.col("r_id"))).alias("b")
    return pairs.groupBy("l_id", "doc_id").agg(best).select("l_id", "doc_id", F.col("b.r_id").alias("r_id"), (-F.col("b.d")).alias("depth"))


def coverage_gaps(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Parts of each document that no span covers: doc_id, gap_start, gap_end.

    ``spans(doc_id, start, end)``, ``lengths(doc_id, n_chars)``.
    """
    seen = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.union(lengths.select("doc_id", F.col("n_chars").alias("start"), F.col("n_chars").alias("end")))
    return ends.select("doc_id", F.coalesce(F.max("end").over(seen), F.lit(0)).alias("gap_start"), F.col("start").alias("gap_end")).where("gap_end > gap_start")


def section_ends(sections: DataFrame, lengths: DataFrame) -> DataFrame:
    """Each section ends where the next begins, the last at the text's end."""
    nxt = F.lead("char_start").over(Window.partitionBy("doc_id").orderBy("char_start"))
    return sections.join(lengths, "doc_id").withColumn("char_end", F.coalesce(nxt, "n_chars")).drop("n_chars")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(doc_id, path, ancestor, depth): the path's prefixes, an equi-join key instead of a prefix test."""
    parts = F.split("path", r"\.")
    prefix = F.explode(F.sequence(F.lit(1), F.size(parts)))
    return nodes.select("doc_id", "path", parts.alias("parts"), prefix.alias("depth")).select("doc_id", "path", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), ".").alias("ancestor"), (F.col("depth") - 1).alias("depth"))


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Nodes at or below the (doc_id, ancestor) pairs of ``of``."""
    return ancestors(nodes).join(of, ["doc_id", "ancestor"], "left_semi").select("doc_id", "path").distinct()


def centred(start, end, window: int, length):
    """(low, high) columns of a window around a span, slid inside the text."""
    low = F.least(F.greatest(F.floor((start + end - window) / 2), F.lit(0)), F.greatest(length - window, F.lit(0)))
    return low.cast("int"), F.least(low + window, length).cast("int")


def neighbours(rows: DataFrame, target: DataFrame, key: str, position: str, before: int, after: int) -> DataFrame:
    """Rows up to ``before`` and ``after`` positions around each target (key, position) in its document."""
    offsets = F.explode(F.sequence(F.lit(-before), F.lit(after)))
    wanted = target.select(key, F.col(position).alias("target"), offsets.alias("offset")).withColumn(position, F.col("target") + F.col("offset"))
    return rows.join(wanted, [key, position])
