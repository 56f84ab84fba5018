"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search on it.

Identical vectors form one class.  The graph starts from random neighbours and
is improved by NN-descent until a round changes less than ``SETTLED`` of the
neighbour slots: every class introduces a sample of its neighbours and of the
classes that have it as theirs to each other, through Spark joins.  Pairs of
which neither side is new there have met before and are left out.  Each class
keeps its ``K`` best.  Queries are searched greedily, all in step: each keeps a
beam of the best classes found, expands those not yet expanded, and stops when
none is left.  The beam's classes are then scored exactly, in double precision,
on the original vectors.

A round ships each sampled vector once to each of its at most
``2 * (SAMPLE + REVERSE)`` introducers, in ``PASSES`` parts, of which only one
is stored at a time; nothing else that is shipped holds a vector.  While all
8-bit vectors take at most ``SMALL_BYTES``, they are broadcast instead, and a
round shuffles twice: edges to their introducers, and what they find.  Inside
the graph, vectors are 8-bit; that affects only which classes are looked at.
Measured recall at 5 is in the README.  The beam grows with each doubling of
the number of classes.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; of vectors of different lengths, the shorter counts as
filled up with zeros (inside the graph, only as many components are looked at
as most vectors have); a query with fewer than five candidates gets them all;
rows repeated with one ``vec_id`` count once; a null ``vec_id`` takes no part;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, discard, small_batches

#: Neighbours kept; neighbours and reverse neighbours introduced a round, of new and of old ones each; proposals a member takes from one introducer.
K, SAMPLE, REVERSE, PROPOSALS = 28, 14, 14, 4
#: Parts of a round; random dealings at the start, and neighbours taken from each.
PASSES, DEALINGS = 3, 4
#: Share of changed neighbour slots below which the graph is settled.
SETTLED = 0.05
#: The beam for up to ``SMALL`` classes, and what each doubling beyond adds.
SMALL, BEAM, MORE_BEAM = 1 << 14, 112, 24
#: Classes per query that are scored exactly, besides 4 for each neighbour asked for.
FINAL = 32
#: What is looked up is broadcast if it takes at most so many bytes, else shuffled.
SMALL_BYTES = 8 << 20
_GRAPH = "id long, q8 binary, nbrs binary, sims binary, fresh binary, worst float, added int"
_FOUND = "id long, nbrs binary, sims binary"


def _small(df: DataFrame, size: int) -> DataFrame:
    """``df``, with a hint to broadcast it if its ``size`` bytes are few."""
    return F.broadcast(df) if size <= SMALL_BYTES else df


def _vector_bytes(count: int, dim: int) -> int:
    return count * (dim + 24)


def _few(df: DataFrame, size: int) -> DataFrame:
    """``df``, if what it is made from is small, in no more tasks than keep all cores busy: starting one costs more than its rows."""
    return df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df


def beam_width(count: int) -> int:
    """The beam for ``count`` classes."""
    return BEAM + MORE_BEAM * math.ceil(max(0.0, math.log2(max(1, count) / SMALL)))


def _i64(parts) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=np.int64)


def _unit(parts, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(parts), dtype=np.int8).reshape(-1, dim).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _starts(owner: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)


def _ranks(owner: np.ndarray) -> np.ndarray:
    """Position of each row in its run of equal values."""
    start = _starts(owner)
    return np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))


def _mix64(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def best_of(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, late: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` most similar distinct others of each owner, in order; of repeats, one that isn't ``late`` stays."""
    o = np.lexsort((late, other, owner))
    a, b = owner[o], other[o]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    o = o[new]
    o = o[np.lexsort((other[o], -sim[o], owner[o]))]
    return o[_ranks(owner[o]) < k]


def _runs(owner: np.ndarray, *values: np.ndarray) -> list:
    """The owners of sorted ``owner``, and for each array the bytes of every owner's run."""
    start = _starts(owner)
    stop = np.append(start[1:], len(owner))[: len(start)].tolist()
    out: list = [owner[start]]
    for v in values:
        data, size = np.ascontiguousarray(v).tobytes(), v.dtype.itemsize
        out.append([data[size * a : size * b] for a, b in zip(start.tolist(), stop, strict=True)])
    return out


def _sampled(owner: np.ndarray, other: np.ndarray, fresh: np.ndarray, salt: int) -> np.ndarray:
    """Which edges take part in a round: of each owner ``SAMPLE`` fresh and ``SAMPLE`` other ones, by a hash."""
    turn = _mix64(owner.view(np.uint64) ^ _mix64(other.view(np.uint64) + np.uint64(salt)))
    o = np.lexsort((turn, fresh, owner))
    group = _mix64(owner.view(np.uint64) * np.uint64(2) + fresh.astype(np.uint64))[o]
    take = np.zeros(len(owner), dtype=bool)
    take[o] = _ranks(group) < SAMPLE
    return take


def prepare(vectors: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows(vec_id, id, embedding) that take part, classes(id, vec_id, nth) the ``k + 1`` smallest ids of each."""
    # Floats stay floats, which halves what is stored; scores are taken in double precision.
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(
        "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    )
    rows = cut(rows.withColumn("id", F.xxhash64(F.sha2(F.col("embedding").cast("string"), 256))))
    spread = rows.select("id", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for keys in (("id", "salt"), ("id",)):
        spread = spread.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    return rows, cut(spread.select("id", "vec_id", "nth"))


def _by_bucket(df: DataFrame, per: int, count: int, key: str = "id") -> DataFrame:
    buckets = max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // per)
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))


def _random_neighbours(codes: DataFrame, dim: int, count: int) -> DataFrame:
    """``_FOUND``: the next few classes in each of some random orders."""
    each = -(-K // DEALINGS)
    deals = codes.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALINGS - 1)))).withColumn("order", F.xxhash64("id", "deal"))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "id"], kind="stable")
        ids, x, n = pdf["id"].to_numpy(), _unit(pdf["q8"], dim), len(pdf)
        steps = range(1, min(each, n - 1) + 1)
        owner = np.repeat(ids, len(steps))
        other = np.stack([np.roll(ids, -s) for s in steps], axis=1).ravel() if n > 1 else ids[:0]
        sims = np.stack([(x * np.roll(x, -s, axis=0)).sum(axis=1) for s in steps], axis=1).ravel() if n > 1 else np.zeros(0, np.float32)
        o = np.argsort(owner, kind="stable")
        names, nbrs, sims = _runs(owner[o], other[o], sims[o].astype(np.float32))
        return pd.DataFrame({"id": names, "nbrs": nbrs, "sims": sims})

    parts = max(1, count // 4096)
    return deals.withColumn("part", F.pmod(F.xxhash64("order"), F.lit(parts))).groupBy("deal", "part").applyInPandas(follow, _FOUND)


def _merge(graph: DataFrame, found: list[DataFrame], count: int, dim: int, salt: int) -> DataFrame:
    """The graph with each class's K best of what it has and what was found for it."""
    rows = graph.select("id", "q8", "nbrs", "sims", "fresh")
    for part in found:
        rows = rows.union(part.select("id", F.lit(None).cast("binary").alias("q8"), "nbrs", "sims", F.lit(None).cast("binary").alias("fresh")))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        old = pdf["q8"].notna().to_numpy()
        pdf = pd.concat([pdf[old], pdf[~old]])
        held = int(old.sum())
        sizes = pdf["nbrs"].str.len().to_numpy() // 8
        owner, other = np.repeat(pdf["id"].to_numpy(), sizes), _i64(pdf["nbrs"])
        sim = np.frombuffer(b"".join(pdf["sims"]), np.float32)
        kept = int(sizes[:held].sum())
        fresh, late = np.ones(len(owner), dtype=np.int8), np.zeros(len(owner), dtype=bool)
        late[kept:] = True
        fresh[:kept] = np.frombuffer(b"".join(pdf["fresh"].iloc[:held]), np.int8)
        fresh[:kept][_sampled(owner[:kept], other[:kept], fresh[:kept], salt)] = 0
        o = best_of(owner, other, sim, late, K)
        names, nbrs, sims, flags, lates = _runs(owner[o], other[o], sim[o], fresh[o], late[o])
        out = pd.DataFrame({"id": names, "nbrs": nbrs, "sims": sims, "fresh": flags, "worst": np.array([np.frombuffer(s[-4:], np.float32)[0] if len(s) >= 4 * K else -2 for s in sims], np.float32), "added": np.array([sum(x) for x in lates], np.int32)})
        own = pdf.iloc[:held][["id", "q8"]].merge(out, on="id", how="left")
        for c in ("nbrs", "sims", "fresh"):
            own[c] = [b"" if isinstance(v, float) else v for v in own[c]]
        own["worst"], own["added"] = own["worst"].fillna(-2).astype(np.float32), own["added"].fillna(0).astype(np.int32)
        return own[["id", "q8", "nbrs", "sims", "fresh", "worst", "added"]]

    return cut(_few(_by_bucket(rows, 2000, count).groupBy("bucket").applyInPandas(merge, _GRAPH), _vector_bytes(count, dim)))


def _directed(owner: np.ndarray, other: np.ndarray, new: np.ndarray, salt: int, most: int) -> pd.DataFrame:
    """Edges as their owner sees them, and backwards; of those that lead to one class only the ``most`` first by ``turn``."""
    turn = _mix64(owner.view(np.uint64) + np.uint64(salt)).view(np.int64)
    o = np.lexsort((owner, turn, new, other))
    group = _mix64(other.view(np.uint64) * np.uint64(2) + new.astype(np.uint64))[o]
    o = o[_ranks(group) < most]
    both = lambda a, b: np.concatenate([a, b[o]])
    return pd.DataFrame({"hub": both(owner, other), "member": both(other, owner), "new": both(new, new), "back": np.arange(len(owner) + len(o)) >= len(owner), "turn": both(turn, turn)})


_DIRECTED = "hub long, member long, new boolean, back boolean, turn long"


def _introduce(graph: DataFrame, dim: int, count: int, salt: int, part: int, parts: int) -> DataFrame:
    """``_FOUND``: what the members that one part of the introducers brings together learn of each other."""

    def spread(batches):
        for pdf in batches:
            sizes = pdf["nbrs"].str.len().to_numpy() // 8
            owner, other, fresh = np.repeat(pdf["id"].to_numpy(), sizes), _i64(pdf["nbrs"]), np.frombuffer(b"".join(pdf["fresh"]), np.int8)
            take = _sampled(owner, other, fresh, salt)
            yield _directed(owner[take], other[take], fresh[take] > 0, salt, REVERSE)

    edges = graph.select("id", "nbrs", "fresh").mapInPandas(spread, _DIRECTED).where(F.pmod(F.xxhash64("hub", F.lit(salt)), F.lit(parts)) == part)
    # Dealt by bucket, edges are ranked and introduced where they are; of its own a class has at most SAMPLE anyway.
    nth = F.row_number().over(Window.partitionBy("bucket", "hub", "back", "new").orderBy("turn", "member"))
    at = _by_bucket(edges, 1000, count, "hub").repartition("bucket").withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("back"), REVERSE).otherwise(SAMPLE))
    known = _small(graph.select(F.col("id").alias("member"), "q8", "worst"), _vector_bytes(count, dim))
    joined = at.join(known, "member").select("bucket", "hub", "member", "new", "q8", "worst")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hub", "member", "new"], ascending=[True, True, False], kind="stable")
        hub, ids = pdf["hub"].to_numpy(), pdf["member"].to_numpy()
        once = np.ones(len(hub), dtype=bool)
        once[1:] = (hub[1:] != hub[:-1]) | (ids[1:] != ids[:-1])
        hub, ids, new, worst, x = hub[once], ids[once], pdf["new"].to_numpy()[once], pdf["worst"].to_numpy()[once], _unit(pdf["q8"].to_numpy()[once], dim)
        start = _starts(hub)
        rank, row = _ranks(hub), np.repeat(np.arange(len(start)), np.diff(np.append(start, len(hub))))
        width = int(rank.max()) + 1
        place = np.full((len(start), width), -1)
        place[row, rank] = np.arange(len(hub))
        owner, other, sims = [], [], []
        for lo in range(0, len(place), 128):
            at = place[lo : lo + 128]
            some, own = x[at], at >= 0
            sim = some @ some.transpose(0, 2, 1)
            fit = own[:, :, None] & own[:, None, :] & (new[at][:, :, None] | new[at][:, None, :]) & (sim > worst[at][:, :, None])
            fit[:, np.arange(width), np.arange(width)] = False
            sim = np.where(fit, sim, np.float32(-9))
            best = np.argpartition(-sim, PROPOSALS - 1, axis=2)[:, :, :PROPOSALS] if width > PROPOSALS else np.broadcast_to(np.arange(width), sim.shape)
            value = np.take_along_axis(sim, best, 2)
            h, i, j = np.nonzero(value > -9)
            owner.append(at[h, i])
            other.append(at[h, best[h, i, j]])
            sims.append(value[h, i, j])
        owner, other, sims = ids[np.concatenate(owner)], ids[np.concatenate(other)], np.concatenate(sims).astype(np.float32)
        o = np.argsort(owner, kind="stable")
        names, nbrs, values = _runs(owner[o], other[o], sims[o])
        return pd.DataFrame({"id": names, "nbrs": nbrs, "sims": values})

    return _few(joined.groupBy("bucket").applyInPandas(meet, _FOUND), _vector_bytes(count, dim))


def build_graph(codes: DataFrame, count: int, dim: int, rounds: int | None = None) -> DataFrame:
    """The neighbour graph of ``codes(id, q8)``: per class its K best, most similar first.

    ``rounds`` ends the descent early (0: random neighbours only), to see what it brings.
    """
    nothing = codes.select("id", "q8", *[F.lit(b"").alias(c) for c in ("nbrs", "sims", "fresh")])
    graph, n = _merge(nothing, [_random_neighbours(codes, dim, count)], count, dim, 0), 0
    while rounds is None or n < rounds:
        n += 1
        if _vector_bytes(count, dim) <= SMALL_BYTES:
            found = [_introduce(graph, dim, count, n, 0, 1)]
        else:
            found = [cut(_introduce(graph, dim, count, n, part, PASSES)) for part in range(PASSES)]
        better = _merge(graph, found, count, dim, n)
        for old in (graph, *found):
            discard(old)
        graph = better
        if (graph.agg(F.sum("added")).first()[0] or 0) <= SETTLED * K * count:
            break
    return graph


def _links(graph: DataFrame, count: int, dim: int) -> DataFrame:
    """(a, ends): of each class where its edges end, and where up to 2K of those that lead to it begin."""

    def spread(batches):
        for pdf in batches:
            sizes = pdf["nbrs"].str.len().to_numpy() // 8
            owner = np.repeat(pdf["id"].to_numpy(), sizes)
            yield _directed(owner, _i64(pdf["nbrs"]), np.zeros(len(owner), bool), 99, 2 * K)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hub", "back", "turn", "member"])
        nth = _ranks(_mix64(pdf["hub"].to_numpy().view(np.uint64) * np.uint64(2) + pdf["back"].to_numpy().astype(np.uint64)))
        pdf = pdf[~pdf["back"].to_numpy() | (nth < 2 * K)].drop_duplicates(["hub", "member"]).sort_values(["hub", "member"])
        names, ends = _runs(pdf["hub"].to_numpy(), pdf["member"].to_numpy())
        return pd.DataFrame({"a": names, "ends": ends})

    edges = graph.select("id", "nbrs").mapInPandas(spread, _DIRECTED)
    return cut(_few(_by_bucket(edges, 2000, count, "hub").groupBy("bucket").applyInPandas(gather, "a long, ends binary"), _vector_bytes(count, dim)))


_STATE = "q long, q8 binary, ids binary, sims binary, done binary, seen binary, open int"


def search(codes: DataFrame, graph: DataFrame, queries: DataFrame, dim: int, count: int, final: int = FINAL) -> DataFrame:
    """(q, id) of the best classes found for each class of ``queries(q)``, which are graph nodes."""
    links = _links(graph, count, dim)
    beam = beam_width(count)
    bucket = lambda df: _by_bucket(df, 500, count // 50, "q")

    def begin(batches):
        for pdf in batches:
            ids = [np.int64(i).tobytes() for i in pdf["q"]]
            yield pd.DataFrame({"q": pdf["q"], "q8": pdf["q8"], "ids": ids, "sims": [np.float32(1).tobytes()] * len(pdf), "done": [b"\0"] * len(pdf), "seen": ids, "open": np.ones(len(pdf), np.int32)})

    state = cut(queries.join(codes, F.col("q") == F.col("id")).select("q", "q8").mapInPandas(begin, _STATE))

    def frontier(batches):
        for pdf in batches:
            ids, done = [np.frombuffer(i, np.int64) for i in pdf["ids"]], [np.frombuffer(d, np.int8) for d in pdf["done"]]
            todo = [i[d == 0] for i, d in zip(ids, done, strict=True)]
            yield pd.DataFrame({"q": np.repeat(pdf["q"].to_numpy(), [len(t) for t in todo]), "node": np.concatenate([np.zeros(0, np.int64), *todo])})

    def advance(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        owner = new["q"].to_numpy()
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], new["id"].to_numpy()[order]
        x = _unit(new["q8"].to_numpy()[order], dim) if len(new) else np.zeros((0, dim), np.float32)
        out = []
        for r in old.itertuples(index=False):
            lo, hi = np.searchsorted(owner, [r.q, r.q + 1]) if r.q < 2**63 - 1 else (np.searchsorted(owner, r.q), len(owner))
            seen, have, sims = np.frombuffer(r.seen, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.sims, np.float32)
            fresh = ~np.isin(ids[lo:hi], seen)
            got, first = np.unique(ids[lo:hi][fresh], return_index=True)
            near = (x[lo:hi][fresh] @ _unit([r.q8], dim)[0])[first] if len(got) else np.zeros(0, np.float32)
            ids_, sims_, done = np.concatenate([have, got]), np.concatenate([sims, near]), np.concatenate([np.ones(len(have), np.int8), np.zeros(len(got), np.int8)])
            top = np.lexsort((ids_, -sims_))[:beam]
            out.append((r.q, r.q8, ids_[top].tobytes(), sims_[top].astype(np.float32).tobytes(), done[top].tobytes(), np.concatenate([seen, got]).tobytes(), int((done[top] == 0).sum())))
        return pd.DataFrame(out, columns=["q", "q8", "ids", "sims", "done", "seen", "open"])

    def ends(batches):
        for pdf in batches:
            sizes = pdf["ends"].str.len().to_numpy() // 8
            yield pd.DataFrame({"q": np.repeat(pdf["q"].to_numpy(), sizes), "id": _i64(pdf["ends"])}).drop_duplicates()

    while open_ := state.agg(F.sum("open")).first()[0]:
        todo = state.where("open > 0").select("q", "ids", "done").mapInPandas(frontier, "q long, node long")
        asked = links.join(_small(todo, 16 * open_), F.col("node") == F.col("a")).select("q", "ends").mapInPandas(ends, "q long, id long")
        answers = bucket(asked).repartition("bucket").distinct().join(_small(codes, _vector_bytes(count, dim)), "id").select("bucket", "q", "id", "q8")
        nxt = cut(_few(bucket(state).groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(advance, _STATE), _vector_bytes(count, dim)))
        discard(state)
        state = nxt

    def leaders(batches):
        for pdf in batches:
            ids = [np.frombuffer(i, np.int64)[:final] for i in pdf["ids"]]
            yield pd.DataFrame({"q": np.repeat(pdf["q"].to_numpy(), [len(t) for t in ids]), "id": np.concatenate([np.zeros(0, np.int64), *ids])})

    discard(links)
    return cut(state.select("q", "ids").mapInPandas(leaders, "q long, id long"))


def _dot(a: Column, b: Column) -> Column:
    """Of arrays of different lengths, the shorter counts as filled up with zeros."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, rounds: int | None = None) -> DataFrame:
    """For each vec_id divisible by ``every``: its ``k`` nearest others found, (query_id, rank, vec_id, score)."""
    small_batches(vectors.sparkSession, "16m")
    rows, classes = prepare(vectors, k)
    exact = cut(rows.select("id", "embedding").dropDuplicates(["id"]))
    usual = exact.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = usual["dim"] if usual else 1

    def shrink(batches):
        for pdf in batches:
            if len(pdf):
                x = np.zeros((len(pdf), dim))
                for row, v in zip(x, pdf["embedding"], strict=True):
                    row[: len(v)] = v[:dim]
                x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
                yield pd.DataFrame({"id": pdf["id"], "q8": [v.tobytes() for v in np.rint(x * 127).astype(np.int8)]})

    codes = cut(exact.mapInPandas(shrink, "id long, q8 binary"))
    count = codes.count()
    asked = cut(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")).distinct())
    discard(rows)
    graph = build_graph(codes, count, dim, rounds)
    found = search(codes, graph, asked.select("q").distinct(), dim, count, FINAL + 4 * k)
    discard(graph)
    u, v = F.col("u"), F.col("v")
    pairs = (
        _small(found, 16 * found.count()).join(exact.select("id", F.col("embedding").cast("array<double>").alias("v")), "id")
        .join(exact.select(F.col("id").alias("q"), F.col("embedding").cast("array<double>").alias("u")), "q")
        .select("q", "id", (_dot(u, v) / (F.sqrt(_dot(u, u)) * F.sqrt(_dot(v, v)))).alias("score"))
    )
    scored = cut(pairs).join(classes.select("id", "vec_id"), "id").join(asked, "q").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
