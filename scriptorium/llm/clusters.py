"""Centroid clustering of integer vectors: k-means rounds with Elkan's bounds.

Each vector keeps an upper bound on the distance to its own centroid and a lower
bound to each of the k.  A centroid is skipped where its lower bound, or half
its distance from the vector's own centroid, exceeds the upper bound; after an
update the bounds move by how far the centroids moved.  Bounds are floating
point numbers rounded outwards, and a centroid is skipped only if it is strictly
farther, so ties still go to the smaller number.  Whatever isn't skipped is
compared by exact squared distances of integers.

The bounds live in a written table, one row a vector, that each round replaces;
it survives lost executors.  What the driver sees is bounded: k centroids, and
the sums of k clusters, which tasks add up before they are shuffled.

Defined results: a vector takes part if it has exactly ``WIDTH`` components,
none of them null or not finite.  A vector with floor(SCALE * x) beyond +-2**52
takes no part either: no 64-bit distance could hold it.  Smaller components are
exact throughout (Python integers where 64 bits don't do); distances and
inertias beyond 64 bits come out as null.  A null ``vec_id`` is the last choice for a first centroid,
and of vectors that share one, the smaller components come first.  Fewer vectors
than k give fewer centroids; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, discard, small_batches

WIDTH, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components up to which sums of squared differences of ``WIDTH`` components fit in 64 bits, and the largest that are kept.
EXACT, LARGEST = 1 << 27, 1 << 52
#: More than the relative error of a rounded root, sum or difference.
SLACK = 2.0**-48
_STATE = "vec_id {0}, v array<long>, cluster int, upper double, lower array<double>"


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _fixed(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel()))


def _integers(width: int, scale: int):
    """(vec_id, v) of the batch's vectors that take part."""

    def scan(batches):
        for batch in batches:
            lists = batch.column("embedding")
            right = pc.fill_null(pc.equal(pc.list_value_length(lists), width), False)
            batch = batch.filter(right)
            if not len(batch):
                continue
            values = batch.column("embedding").flatten().cast(pa.float64())
            known = np.asarray(values.is_valid()).reshape(-1, width)
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(np.nan_to_num(values.to_numpy(zero_copy_only=False), nan=np.inf).reshape(-1, width) * scale)
            keep = known.all(1) & (np.abs(scaled) <= LARGEST).all(1)
            if keep.any():
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(keep)), _fixed(scaled[keep].astype(np.int64))], names=["vec_id", "v"])

    return scan


def kept_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, in integers."""
    key = dict(vectors.dtypes)["vec_id"]
    return vectors.select("vec_id", "embedding").mapInArrow(_integers(width, scale), f"vec_id {key}, v array<long>")


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors of the smallest hashes of seed and id, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in kept.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()]


def squared(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``v`` from ``centre`` (64-bit, or Python integers if they may not fit)."""
    d = v - centre
    return (d * d).sum(axis=1)


def _exact_pair(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which squared distances are exact."""
    most = max([0, *(abs(x) for c in centroids for x in c)])
    small = most < EXACT and (not v.size or (v.max() < EXACT and v.min() > -EXACT))
    kind = np.int64 if small else object
    return v.astype(kind), np.array(centroids, dtype=kind)


def above(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def below(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0) * (1 - SLACK)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def assign(v: np.ndarray, centroids: list[list[int]], moved: np.ndarray | None, half: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
    """New (cluster, upper, lower) of a batch, and how many distances were computed; without ``cluster`` the batch is new."""
    v, c = _exact_pair(v, centroids)
    n, k = len(v), len(centroids)
    if cluster is None:
        cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
    else:
        cluster, upper, lower = cluster.astype(np.int64), above(upper + moved[cluster]), below(lower - moved)
    # How far the nearest other centroid is from the own one, halved: within that no other can be nearer or tie.
    apart = np.where(np.eye(k, dtype=bool), np.inf, half)
    open_ = np.flatnonzero(~(upper < apart.min(axis=1)[cluster]))
    can = lambda at, c: (c != cluster[at]) & ~(lower[at, c] > upper[at]) & ~(half[cluster[at], c] > upper[at])
    open_ = open_[np.any([can(open_, j) for j in range(k)], axis=0)] if len(open_) and k > 1 else open_[:0]
    best = np.zeros(n, dtype=v.dtype)
    best[open_] = _to_own(v, c, open_, cluster)
    computed = len(open_)
    upper[open_] = above(_root(best[open_]))
    lower[open_, cluster[open_]] = below(_root(best[open_]))
    for j in range(k):
        at = open_[can(open_, j)]
        if not len(at):
            continue
        d = squared(v[at], c[j])
        computed += len(at)
        lower[at, j] = below(_root(d))
        nearer = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
        won = at[nearer]
        best[won], cluster[won] = d[nearer], j
        upper[won] = above(_root(best[won]))
    return cluster, upper, lower, computed


def _to_own(v: np.ndarray, c: np.ndarray, at: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    d = v[at] - c[cluster[at]]
    return (d * d).sum(axis=1)


def _distances(centroids: list[list[int]], others: list[list[int]]) -> np.ndarray:
    """Matrix of exact squared distances as Python integers."""
    a, b = np.array(centroids, dtype=object), np.array(others, dtype=object)
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def _step(centroids: list[list[int]], before: list[list[int]] | None):
    """A pass over the state: vectors meet ``centroids``, which were ``before`` when the bounds were made."""
    half = below(_root(_distances(centroids, centroids)) / 2)
    moved = None if before is None else above(_root(np.diagonal(_distances(centroids, before))))

    def scan(batches):
        for batch in batches:
            if not len(batch):
                continue
            old = (None, None, None) if before is None else (batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), _matrix(batch.column("lower"), len(centroids)))
            cluster, upper, lower, _ = assign(_matrix(batch.column("v"), len(centroids[0])), centroids, moved, half, *old)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), _fixed(lower)], names=["vec_id", "v", "cluster", "upper", "lower"])

    return scan


def _partial_sums(batches):
    """(cluster, at, total, n) of each batch: the sum of one component; sums of large ones are Python integers."""
    for batch in batches:
        cluster, v = batch.column("cluster").to_numpy(), _matrix(batch.column("v"), batch.column("v").value_lengths()[0].as_py() if len(batch) else 1)
        if not len(cluster):
            continue
        if np.abs(v.astype(np.float64)).max() * len(v) > 2.0**62:
            v = v.astype(object)
        order = np.argsort(cluster, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(cluster[order]) != 0]))
        sums, n = np.add.reduceat(v[order], start, axis=0), np.diff(np.append(start, len(cluster)))
        width = v.shape[1]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(cluster[order][start], width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(start))),
            _decimals(sums.ravel()), pa.array(np.repeat(n, width)),
        ], names=["cluster", "at", "total", "n"])


def updated(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Componentwise floor of the mean of each cluster; an empty one keeps its centroid."""
    parts = state.select("cluster", "v").mapInArrow(_partial_sums, "cluster int, at int, total decimal(38,0), n long")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k * width rows
        out[r.cluster][r.at] = int(r.total) // r.n
    return out


def _decimals(x: np.ndarray) -> pa.Array:
    wide = pa.decimal128(38, 0)
    return pa.array([int(i) for i in x], wide) if x.dtype == object else pa.array(x).cast(wide)


def _final(centroids: list[list[int]]):
    def scan(batches):
        for batch in batches:
            if len(batch):
                v, c = _exact_pair(_matrix(batch.column("v"), len(centroids[0])), centroids)
                cluster = batch.column("cluster").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), _decimals(_to_own(v, c, np.arange(len(v)), cluster))], names=["vec_id", "cluster", "distance"])

    return scan


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance as decimal(38,0)) after ``rounds`` updates and a last assignment, and the centroids."""
    spark = vectors.sparkSession
    small_batches(spark, "4m")
    kept = cut(kept_vectors(vectors, width, scale))
    key = dict(kept.dtypes)["vec_id"]
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        return spark.createDataFrame([], f"vec_id {key}, cluster int, distance decimal(38,0)"), []
    state, before = kept, None
    for r in range(rounds + 1):
        nxt = cut(state.mapInArrow(_step(centroids, before), _STATE.format(key)))
        discard(state)
        state, before = nxt, centroids
        if r < rounds:
            centroids = updated(state, centroids)
    return state.select("vec_id", "v", "cluster").mapInArrow(_final(centroids), f"vec_id {key}, cluster int, distance decimal(38,0)"), centroids


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    found, centroids = cluster_vectors(vectors, k, rounds, width, scale, seed)
    found = cut(found)
    inertia = {r.cluster: None if r.inertia is None else int(r.inertia) for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()}  # k rows
    whole = None if None in inertia.values() else sum(inertia.values())
    long = lambda x: None if x is None or x >= 2**63 else x
    about = [(c, long(inertia[c]), long(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in inertia]
    notes = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(notes), "cluster").select("vec_id", "cluster", F.expr("try_cast(distance as long)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
