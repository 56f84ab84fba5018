"""Helpers shared by the training-data operators: scratch tables, lookups, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that word operators split on: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent (a local test session) is a temporary
    folder of this machine used, and then kept for the whole session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back (cuts lineage).

    Unlike a local checkpoint the copy survives the loss of any executor.  The
    shuffle files of the write go when it is done, as nothing reads them again.
    """
    path, conf, name = scratch_dir(df.sparkSession), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`cut` that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def small_batches(spark: SparkSession, size: str = "16m") -> None:
    """Bound Arrow batches by bytes, so that a few very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` plus a column; an input column of that name gives way to it."""
    return df.drop(name).withColumn(name, value) if name in df.columns else df.withColumn(name, value)


class WordCache:
    """What a worker remembers of words, bounded by (estimated) bytes."""

    #: Bytes of a dictionary entry besides its key's characters.
    ENTRY = 180

    def __init__(self, name: str, budget: int):
        # A plain dictionary: sets are compared fast only with that, not with a subclass.
        self.name, self.budget, self.bytes, self.known = name, budget, 0, {}

    def cost(self, words) -> int:
        return sum(map(len, words)) + self.ENTRY * len(words)

    def clear(self) -> None:
        self.known.clear()
        self.bytes = 0

    def remember(self, new: dict) -> dict:
        """A mapping that holds what is known and ``new``; kept for later only as far as the budget goes."""
        cost = self.cost(new)
        if self.bytes + cost > self.budget:
            return {**self.known, **new}
        self.known.update(new)
        self.bytes += cost
        return self.known

    def values_of(self, words: list, learn) -> dict:
        """A mapping with every one of ``words``; ``learn`` gives the values of a list of new ones."""
        distinct = set(words)
        missing = list(distinct.difference(self.known))
        if not missing:
            return self.known
        if self.bytes + self.cost(missing) > self.budget:
            self.clear()
            missing = list(distinct)
        return self.remember(dict(zip(missing, learn(missing), strict=True)))


#: Bytes that the remembered words of one worker may take.
CACHE_BYTES = 32 << 20
_CACHES: dict[str, WordCache] = {}


def worker_cache(name: str, budget: int | None = None) -> WordCache:
    """This worker's cache of that name; those of other operators, whose stages are over, are emptied."""
    for other, cache in _CACHES.items():
        if other != name and cache.known:
            cache.clear()
            pa.default_memory_pool().release_unused()
    if name not in _CACHES or (budget and _CACHES[name].budget != budget):
        _CACHES[name] = WordCache(name, budget or CACHE_BYTES)
    return _CACHES[name]


def text_bytes(name: str = "text") -> Column:
    """The column's UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def union_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root (smallest member) of each of ``n`` nodes under the edges ``a[i] - b[i]``."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            nxt = root[root]
            if np.array_equal(nxt, root):
                break
            root = nxt
        a, b = root[a], root[b]
        keep = a != b
        a, b = a[keep], b[keep]
    return root


def _forest(batches):
    """Spanning stars of the edges in one partition, a batch at a time."""
    for pdf in batches:
        if len(pdf):
            nodes, inverse = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
            root = union_roots(inverse[: len(pdf)], inverse[len(pdf) :], len(nodes))
            own = np.arange(len(nodes))
            yield pd.DataFrame({"a": nodes[root[own != root]], "b": nodes[own != root]})


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``(node, root)``, root the smallest node.

    Contraction on Spark: each round hooks every node to its smallest
    neighbour, follows those pointers twice, and keeps the edges between
    different roots; rounds grow with the logarithm of the node count.  All
    lookups are many-to-one joins, whose hot keys adaptive execution splits.
    """
    spark = edges.sparkSession
    edges = cut(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct().mapInPandas(_forest, "a long, b long").distinct())
    labels = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        hook = cut(hook)
        for _ in range(2):
            upper = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(upper, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        hook = cut(hook)
        parent = lambda key: hook.select(F.col("node").alias(key), F.col("up").alias(f"{key}_up"))
        nxt = cut(
            edges.join(parent("a"), "a", "left").join(parent("b"), "b", "left")
            .select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
            .where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct()
        )
        if labels is None:
            labels = hook.select("node", F.col("up").alias("root"))
        else:
            moved = hook.select(F.col("node").alias("root"), "up")
            labels = cut(labels.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        edges = nxt
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return spark.createDataFrame([], "node long, root long")
    return labels
