"""Mixing sources to target weights by the cube method.

Sources weigh 5, 2, 1, repeating in code-point order, and share 150% of all
words; a target stops at twice its source's words and the excess is shared
again by weight.  A source's ratio of target to words gives each document its
whole copies and, for the rest, an inclusion probability.  The flight phase
moves these probabilities through the null space of the balancing constraints
(the number of documents and their words) until all but a few are 0 or 1.  It
runs in blocks of bounded size dealt by hash inside each source, then over what
the blocks left open, until a source's open documents are few; the landing then
takes the subset of those few that comes closest to the target.

Defined results: null texts have size 0; null is a source of its own, last;
a source without words has target 0 and its documents one copy each (of no
words); a null ``doc_id`` or repeated rows are documents like others; an empty
table gives an empty result; input columns named like a result column give way.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import WORD, cut

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents that one flight takes, and open documents that the landing enumerates (2 ** LANDING subsets).
BLOCK, LANDING = 4096, 14


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int) -> np.ndarray:
    """Balanced probabilities of which at most ``max(leave, 2)`` are not 0 or 1.

    Three open units at a time move along the vector that keeps both the sum of
    probabilities and the sum of probability times size.
    """
    p = p.astype(float).copy()
    tiny = 1e-9
    p[p < tiny], p[p > 1 - tiny] = 0.0, 1.0
    queue = np.flatnonzero((p > 0) & (p < 1)).tolist()
    queue.reverse()
    active: list[int] = []
    left = len(queue)
    draw = iter(rng.random(4 * len(queue) + 16).tolist())
    s = size.astype(float).tolist()
    q = p.tolist()
    while left > max(leave, 2):
        while len(active) < 3:
            active.append(queue.pop())
        a, b, c = active
        u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - q[i]) / x if x > 0 else q[i] / -x for i, x in zip(active, u, strict=True) if x)
        down = min(q[i] / x if x > 0 else (1 - q[i]) / -x for i, x in zip(active, u, strict=True) if x)
        step = up if next(draw, 0.5) < down / (up + down) else -down
        rest = []
        for i, x in zip(active, u, strict=True):
            v = q[i] + step * x
            if v < tiny:
                q[i] = 0.0
            elif v > 1 - tiny:
                q[i] = 1.0
            else:
                q[i] = v
                rest.append(i)
        left -= 3 - len(rest)
        active = rest
    return np.array(q)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 0/1 choice of at most ``LANDING`` open units whose words, then count, come closest."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    k = len(open_)
    if k:
        picks = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
        s = size[open_].astype(float)
        words = np.abs(picks @ s - p[open_] @ s)
        count = np.abs(picks.sum(axis=1) - p[open_].sum())
        out[open_] = picks[np.lexsort((count, words))[0]]
    return out


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source of ``sizes(source, size)``: source, source_size, target."""
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    # Ranks in code-point order: range partitions are in order, so only their row counts meet on the driver.
    ranged = cut(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    before, offsets = 0, []
    for part, count in counts:
        offsets.append((part, before))
        before += count
    if not offsets:
        return totals.withColumn("target", F.lit(0.0))
    starts = ranged.sparkSession.createDataFrame(offsets, "part int, before long")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    ranked = cut(ranged.join(F.broadcast(starts), "part").withColumn("weight", F.element_at(weights, (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))).select("source", "source_size", "weight", (MOST * F.col("source_size")).alias("cap")))
    whole = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * SHARE
    level = 0.0
    while True:
        full = F.col("cap") < level * F.col("weight")
        taken, weight = ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        nxt = (whole - (taken or 0.0)) / weight if weight else math.inf
        if nxt <= level * (1 + 1e-12):
            break
        level = nxt
        if math.isinf(level):
            break
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _flier(level: int):
    """The flight over one block of a source and, if that is the whole source, its landing."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "row", "doc_id"], ascending=[True, True, True], kind="stable")
        size = pdf["size"].to_numpy()
        seed = (int(pdf["block"].iloc[0]), level, int(size.sum()), int(pdf["row"].iloc[0]) & 0x7FFFFFFF)
        p = flight(pdf["p"].to_numpy(), size, np.random.default_rng(seed), LANDING)
        return pdf.drop(columns=["block", "blocks"]).assign(p=land(p, size) if pdf["blocks"].iloc[0] == 1 else p)

    return fly


_UNIT = "row long, doc_id long, source string, size long, source_size long, target double, base long, p double"


def mix(docs: DataFrame) -> DataFrame:
    """Per row: row (a hash of the row), doc_id, source, size, source_size, target, copies, taken."""
    sizes = cut(
        docs.select(
            F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    targets = cut(source_targets(sizes)).withColumnRenamed("source", "__source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.col("target") / F.col("source_size"))).otherwise(F.lit(1.0))
    units = (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        .withColumn("base", F.floor(ratio).cast("long")).withColumn("p", ratio - F.col("base"))
    ).select(*[x.split()[0] for x in _UNIT.split(", ")])
    units, settled, level = cut(units), [], 0
    while True:
        per = cut(units.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("__source"), F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")))
        most = per.agg(F.max("blocks")).first()[0] or 0
        final = most <= 1

        dealt = units.join(per, F.col("source").eqNullSafe(F.col("__source"))).withColumn("block", F.pmod(F.xxhash64("row", "doc_id", F.lit(level)), F.col("blocks"))).drop("__source")
        flown = cut(dealt.groupBy("source", "block").applyInPandas(_flier(level), _UNIT))
        if final:
            settled.append(flown)
            break
        settled.append(flown.where("p = 0 or p = 1"))
        units, level = flown.where("p > 0 and p < 1"), level + 1
    out = settled[0]
    for part in settled[1:]:
        out = out.union(part)
    copies = (F.col("base") + F.col("p").cast("long")).alias("copies")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns unchanged."""
    names = docs.columns
    plan = cut(mix(docs).groupBy(F.col("row").alias("__row")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__same")))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    rows = docs.withColumn("__key", key).join(plan.where("__copies > 0"), F.col("__key") == F.col("__row"))
    if not plan.where("__same > 1").isEmpty():
        # Rows alike in id, source and text: the first of them stands for all their copies.
        rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy("__row"))).where("__nth = 1")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*names)
