"""Rank operators: vector and keyword top-k, fusion, hybrid search, fuzzy names.

Every limit has a total order that ends in an id, so results are deterministic;
``orderBy().limit()`` plans as TakeOrderedAndProject (top-k per task, then one merge of k rows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.session import bounded_batches, spread

RRF_OFFSET = 60
#: Text-search configurations by ISO 639-1 code, that of other languages, and the weight of a lexeme.
CONFIGS = {
    "ar": "arabic", "da": "danish", "de": "german", "el": "greek", "en": "english", "es": "spanish", "eu": "basque", "fi": "finnish", "fr": "french", "ga": "irish",
    "hi": "hindi", "hu": "hungarian", "hy": "armenian", "id": "indonesian", "it": "italian", "lt": "lithuanian", "ne": "nepali", "nl": "dutch", "no": "norwegian",
    "pt": "portuguese", "ro": "romanian", "ru": "russian", "sr": "serbian", "sv": "swedish", "ta": "tamil", "tr": "turkish", "yi": "yiddish",
}
SIMPLE, WEIGHT = "simple", 0.1
MODES = ("rrf", "weighted", "vector", "keyword")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays; null for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def vector_topk(vectors: DataFrame, query: list[float], k: int, candidates: DataFrame | None = None, min_similarity: float | None = None) -> DataFrame:
    """The ``k`` rows nearest to a literal vector: vec_id, score; optionally among ``candidates(vec_id)``."""
    if candidates is not None:
        vectors = vectors.join(candidates, "vec_id", "left_semi")
    norm = sum(x * x for x in query) ** 0.5
    literal = F.array(*[F.lit(float(x)) for x in query])
    own = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    scored = vectors.select("vec_id", F.when(own > 0, dot(F.col("embedding"), literal) / (own * norm)).alias("score")).where("score is not null")
    if min_similarity is not None:
        scored = scored.where(F.col("score") >= min_similarity)
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def stored_vector(vectors: DataFrame, vec_id: int) -> list[float]:
    """One stored vector (a single row, by id)."""
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    if row is None:
        raise KeyError(f"no vector {vec_id}")
    return [float(x) for x in row["embedding"]]


def similar_to(vectors: DataFrame, vec_id: int, k: int) -> DataFrame:
    """The ``k`` nearest to a stored vector, itself left out."""
    return vector_topk(vectors.where(F.col("vec_id") != vec_id), stored_vector(vectors, vec_id), k)


def language_config(lang: Column) -> Column:
    """The configuration that a language (``de``, ``de-CH``) is indexed under."""
    table = F.create_map(*[F.lit(x) for pair in CONFIGS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.substring(F.lower(F.trim(lang)), 1, 2)), F.lit(SIMPLE))


def inverted_index(docs: DataFrame, lang: Column | None = None) -> DataFrame:
    """(doc_id, lang_config, lexeme, tf, positions): write it partitioned by lang_config to reuse it."""
    config = F.coalesce(lang, F.lit("simple")) if lang is not None else F.lit("simple")
    bounded_batches(docs.sparkSession)
    # A document is one row, so its words are grouped where it is read and nothing is shuffled.
    own = docs.select("doc_id", config.alias("lang_config"), T.words(F.col("text")).alias("words"))
    return own.mapInArrow(_lexemes, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_config string, lexeme string, tf long, positions array<int>")


def _lexemes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of each document (doc_id, lang_config, words) with its positions."""
    for batch in batches:
        words = batch.column("words")
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            continue
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        codes = coded.indices.to_numpy().astype(np.int64)
        keys = rows * len(coded.dictionary) + codes
        order = np.argsort(keys, kind="stable")
        begins = np.flatnonzero(np.diff(keys[order], prepend=-1))
        bounds = np.append(begins, len(order))
        first = order[begins]
        own = [batch.column(c).take(pa.array(rows[first])) for c in ("doc_id", "lang_config")]
        positions = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(at[order], pa.int32()))
        yield pa.RecordBatch.from_arrays([*own, coded.dictionary.take(pa.array(codes[first])), pa.array(np.diff(bounds), pa.int64()), positions], ["doc_id", "lang_config", "lexeme", "tf", "positions"])


def write_index(index: DataFrame, path: str) -> None:
    """Store an inverted index: a folder per configuration, files in order of lexemes, so that a query's scan skips most.

    Ranges are cut by document too, so a frequent lexeme fills many files rather than one task.
    """
    order = ["lang_config", "lexeme", "doc_id"]
    index.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("lang_config").parquet(path)


def cover_topk(index: DataFrame, lexemes: list[str], k: int, config: str | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Documents that hold all lexemes, ranked by cover density: doc_id, score; in one configuration or all, optionally among ``candidates(doc_id)``.

    A cover is a shortest stretch of words that holds all lexemes; it counts ``WEIGHT`` over one more than its other
    words.  Only the asked lexemes of the index are read, and only their positions move.
    """
    if not lexemes:
        raise ValueError("no lexemes")
    if config is not None and config not in {SIMPLE, *CONFIGS.values()}:
        raise ValueError(f"unknown text-search configuration {config!r}")
    wanted = list(dict.fromkeys(w.lower() for w in lexemes))
    rows = index.where(F.col("lexeme").isin(wanted))
    if config is not None:
        rows = rows.where(F.col("lang_config") == config)
    if candidates is not None:
        rows = rows.join(candidates, "doc_id", "left_semi")
    # From the last position to the first, the smallest position met so far of a lexeme is its next one.
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos"))
    placed = rows.select("doc_id", "lexeme", F.explode("positions").alias("pos")).withColumn("here", F.struct("pos", F.row_number().over(back).alias("n")))
    following = [F.min(F.when(F.col("lexeme") == w, F.col("here"))).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias(f"next{i}") for i, w in enumerate(wanted)]
    ahead = placed.select("doc_id", "here", *following).dropna(subset=[f"next{i}" for i in range(len(wanted))])
    last = F.greatest(*[f"next{i}" for i in range(len(wanted))], F.col("here"))
    covers = ahead.select("doc_id", "here", last.alias("last")).groupBy("doc_id", "last").agg(F.max("here").alias("first"))
    others = (F.col("last.pos") - F.col("first.pos")) - (F.col("first.n") - F.col("last.n"))
    scored = covers.groupBy("doc_id").agg(F.round(F.sum(WEIGHT / (1 + others)), 12).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda token: token == F.lit(word)


def keyword_topk(docs: DataFrame, lexemes: list[str], k: int) -> DataFrame:
    """Documents that hold all lexemes, ranked by how often (over document length): doc_id, score.

    The lexemes are counted while the text is scanned, so nothing is exploded or shuffled before the top-k.
    """
    tokens = T.words(F.col("text"))
    wanted = [w.lower() for w in lexemes]
    counts = [F.size(F.filter("tokens", _equals(w))).alias(f"c{i}") for i, w in enumerate(wanted)]
    # A cheap substring test first: only rows that may match are tokenized.
    maybe = docs
    for w in wanted:
        maybe = maybe.where(F.contains(F.lower("text"), F.lit(w)))
    counted = maybe.select("doc_id", tokens.alias("tokens")).select("doc_id", F.size("tokens").alias("n"), *counts)
    total = sum((F.col(f"c{i}") for i in range(1, len(wanted))), F.col("c0"))
    everyone = F.least(*[F.col(f"c{i}") for i in range(len(wanted))], F.lit(1)) > 0
    return counted.where(everyone).select("doc_id", (total / F.col("n")).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def with_rank(ranked: DataFrame, key: str = "id") -> DataFrame:
    """1-based position by score, ties by id; for lists that a top-k has already bounded."""
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def rrf(lists: list[DataFrame], k: int, offset: int = RRF_OFFSET) -> DataFrame:
    """Reciprocal-rank fusion of (id, score) lists; ties go to the earlier list, then its rank."""
    parts = [with_rank(x.select("id", "score")).withColumn("list", F.lit(i)) for i, x in enumerate(lists)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("id").agg(F.sum(1.0 / (offset + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return fused.orderBy(F.desc("score"), "first", "id").limit(k).select("id", "score")


def min_max(ranked: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 over the list; all 0 when they are equal."""
    whole = Window.partitionBy()
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    return ranked.select("id", ((F.col("score") - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))).alias("score"))


def weighted_fusion(vector: DataFrame, keyword: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha * vector + (1 - alpha) * keyword over min-max scores, absent counting 0."""
    a, b = min_max(vector).withColumnRenamed("score", "v"), min_max(keyword).withColumnRenamed("score", "w")
    both = a.join(b, "id", "full")
    score = alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("w", F.lit(0.0))
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid_search(docs: DataFrame, vectors: DataFrame, query_vector: list[float], lexemes: list[str], k: int, pool: int = 100) -> DataFrame:
    """Vector and keyword top-``pool`` fused by reciprocal rank, hydrated: doc_id, score, lang, source, n_chars."""
    vec = vector_topk(vectors, query_vector, pool).select(F.col("vec_id").alias("id"), "score")
    key = keyword_topk(docs, lexemes, pool).select(F.col("doc_id").alias("id"), "score")
    fused = rrf([vec, key], k)
    # At most k rows: the broadcast side has a fixed bound.
    return docs.select("doc_id", "lang", "source", "n_chars").join(F.broadcast(fused), F.col("doc_id") == F.col("id")).select("doc_id", "score", "lang", "source", "n_chars")


def find(
    docs: DataFrame, vectors: DataFrame, index: DataFrame, query_vector: list[float], lexemes: list[str], k: int, mode: str = "rrf", alpha: float = 0.5,
    config: str | None = None, candidates: DataFrame | None = None, pool: int = 100, scorer: Column | None = None, rerank_n: int = 50,
) -> DataFrame:
    """Hybrid search in full: doc_id, score, lang, source, n_chars.

    ``mode``: both lists fused by rank or by weight, or one alone; ``candidates(doc_id)``, if given, are searched only,
    and keywords only under ``config``.  With ``scorer``, a column over ``docs``, the first ``rerank_n`` are put in its order.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    most = k if scorer is None else max(k, rerank_n)
    width = pool if mode in ("rrf", "weighted") else most
    among = None if candidates is None else candidates.select(F.col("doc_id").alias("vec_id"))
    vector = lambda: vector_topk(vectors, query_vector, width, candidates=among).select(F.col("vec_id").alias("id"), "score")
    keyword = lambda: cover_topk(index, lexemes, width, config, candidates).select(F.col("doc_id").alias("id"), "score")
    if mode == "rrf":
        fused = rrf([vector(), keyword()], most)
    elif mode == "weighted":
        fused = weighted_fusion(vector(), keyword(), alpha, most)
    else:
        fused = vector() if mode == "vector" else keyword()
    kept = [c for c in docs.columns if c not in ("id", "score", "rank")]
    # At most ``most`` rows: the broadcast side has a fixed bound.
    hits = docs.select(*kept).join(F.broadcast(with_rank(fused)), F.col("doc_id") == F.col("id"))
    if scorer is not None:
        hits = rerank(hits, scorer, k).drop("score").withColumnRenamed("rerank_score", "score")
    return hits.select("doc_id", "score", "lang", "source", "n_chars")


def rerank(fused: DataFrame, score: Column, k: int) -> DataFrame:
    """Order by a scorer's column, ties in the order given by ``rank``."""
    return fused.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), "rank", "id").limit(k)


def fuzzy_names(names: DataFrame, query: str, k: int, threshold: float = 0.1) -> DataFrame:
    """Names by trigram similarity above a threshold: id, name, score."""
    similarity = T.bound(T.trigrams(F.col("name")), lambda a: T.trigram_similarity(a, T.trigrams(F.lit(query))))
    # The threshold is held against the best k, so that a name is scored once; a filter below the limit would score it again.
    scored = spread(names.select("id", "name")).select("id", "name", similarity.alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k).where(F.col("score") > threshold)
