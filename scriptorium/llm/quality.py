"""Quality classifier: Naive Bayes support vectors.

Indicators of hashed n-grams are scaled by the log-count ratio of their class
counts, and a linear hinge-loss model is fitted to them by dual coordinate
descent.  The n-grams are word unigrams and bigrams, and unigrams to trigrams
of word shapes (case, closing punctuation, length, same as the word before), so
that patterns carry over to words never seen in training.  Margins become
scores by a logistic fit on training rows set aside for it.

Learning uses a bounded sample of labelled rows: about ``max_train`` labels,
chosen by a hash of ``doc_id`` (only ids and labels of that sample are
broadcast), and of their documents, in the order of another hash, at most
``2 * max_train`` rows whose features fill ``max_bytes``.  Scoring covers every
row and whole texts.

Defined results: null and empty texts have no n-gram, so the bias alone scores
them; labels that are null, not 0 or 1, or conflicting for one document are not
learned from; with fewer than two classes to learn from, every score is the
share of label 1 (0.5 without any label); repeated rows are scored alike; an
empty table gives an empty result.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, discard, small_batches, text_bytes, worker_cache

#: Labelled rows that a fit uses at most, about, and the bytes of their features.
MAX_TRAIN, MAX_TRAIN_BYTES = 8000, 96 << 20
BUCKETS = 1 << 18
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _word_code(word: bytes) -> int:
    """A 32-bit hash of the word and, in the low 12 bits, its shape."""
    text = word.decode("utf-8", "replace")
    core = text.rstrip(string.punctuation)
    tail = text[len(core) :]
    case = 2 if core.islower() else 0 if not core else 4 if core.istitle() else 3 if core.isupper() else 1 if core.isnumeric() else 5
    if not tail:
        mark = 0
    elif tail in (".", ","):
        mark = 1
    else:
        mark = 2 + zlib.crc32(tail.encode()) % 62
    size = min(7, len(core) // 3)
    return zlib.crc32(word) << 12 | case << 9 | size << 6 | mark


def _mix(a: np.ndarray, salt: int) -> np.ndarray:
    a = (a + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(31)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    return (a >> np.uint64(64 - 18)).astype(np.int32)


def features(data: bytes) -> np.ndarray:
    """Sorted distinct n-gram buckets of one whole text."""
    words = data.split()
    if not words:
        return np.zeros(0, dtype=np.int32)
    known = worker_cache("quality").values_of(words, lambda new: list(map(_word_code, new)))
    code = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    shape = code & np.uint64(0xFFF)
    word = code >> np.uint64(12)
    same = np.zeros(len(words), dtype=np.uint64)
    same[1:] = word[1:] == word[:-1]
    shape = shape | same << np.uint64(12)
    wide = np.uint64(1 << 13)
    parts = [_mix(word, 1), _mix(shape, 3)]
    if len(words) > 1:
        parts += [_mix(word[:-1] * np.uint64(0x2545F4914F6CDD1D) + word[1:], 2), _mix(shape[:-1] * wide + shape[1:], 4)]
    if len(words) > 2:
        parts.append(_mix((shape[:-2] * wide + shape[1:-1]) * wide + shape[2:], 5))
    seen = np.zeros(BUCKETS, dtype=bool) if len(words) > 20_000 else None
    if seen is not None:
        for p in parts:
            seen[p] = True
        return np.flatnonzero(seen).astype(np.int32)
    return np.unique(np.concatenate(parts))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the class counts p and q of each indicator."""
    counts = []
    for label in (1, 0):
        own = [x for x, v in zip(rows, y, strict=True) if v == label]
        c = smooth + np.bincount(np.concatenate(own) if own else np.zeros(0, np.int32), minlength=BUCKETS)
        counts.append(c / c.sum())
    return np.log(counts[0] / counts[1])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, passes: int = 30, seed: int = 0) -> np.ndarray:
    """Weights (bias last) of the L1-loss linear support vector machine over scaled indicators."""
    rng = np.random.default_rng(seed)
    values = [ratio[x] for x in rows]
    # Each text has unit length, so that long texts don't rule the fit.
    norms = [max(1e-9, float(np.sqrt(v @ v))) for v in values]
    values = [v / n for v, n in zip(values, norms, strict=True)]
    w, alpha, sign = np.zeros(BUCKETS + 1), np.zeros(len(rows)), np.where(y == 1, 1.0, -1.0)
    share = max(1e-3, float((y == 1).mean()))
    upper = np.where(y == 1, cost / (2 * share), cost / (2 * max(1e-3, 1 - share)))
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v, s = rows[i], values[i], sign[i]
            slope = s * (float(w[x] @ v) + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / (float(v @ v) + 1.0), 0.0), upper[i])
            if (step := new - alpha[i]) != 0.0:
                w[x] += step * s * v
                w[-1] += step * s
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def _margins(rows: list[np.ndarray], w: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for i, x in enumerate(rows):
        v = ratio[x]
        out[i] = w[-1] + (float(w[x] @ v) / float(np.sqrt(v @ v)) if len(x) and v.any() else 0.0)
    return out


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic fit (smoothed targets, Newton's method), both classes weighing alike."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / max(pos, 1.0), 0.5 / max(neg, 1.0)) * len(y)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        g, h = weight * (p - t), weight * p * (1 - p)
        grad = np.array([g @ m + 1e-6 * a, g.sum()])
        hess = np.array([[h @ (m * m) + 1e-6, h @ m], [h @ m, h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        size = max(1.0, float(np.abs(step).max()) / 5)
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


class Model:
    """Weights over n-gram buckets, already scaled by the ratios, and the logistic fit."""

    def __init__(self, w: np.ndarray, ratio: np.ndarray, slope: float, shift: float):
        self.weight, self.square, self.bias, self.slope, self.shift = (w[:-1] * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(w[-1]), slope, shift

    def score(self, data: bytes) -> float:
        x = features(data)
        size = float(np.sqrt(self.square[x].sum(dtype=np.float64)))
        margin = self.bias + (float(self.weight[x].sum(dtype=np.float64)) / size if size else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """A model from feature rows and 0/1 labels; a fifth of the rows sets the logistic fit."""
    if len(set(y.tolist())) < 2:
        p = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 0.5
        return Model(np.zeros(BUCKETS + 1), np.ones(BUCKETS), 1.0, float(np.log(p / (1 - p))))
    aside = np.arange(len(y)) % 5 == 0
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), dtype=bool)
    learn = [x for x, a in zip(rows, aside, strict=True) if not a]
    ratio = log_count_ratio(learn, y[~aside])
    w = dual_coordinate_descent(learn, y[~aside], ratio)
    check = aside if aside.any() else ~aside
    return Model(w, ratio, *_logistic(_margins([x for x, c in zip(rows, check, strict=True) if c], w, ratio), y[check]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """Fit on a bounded sample of labelled rows (see above), none of them held out."""
    small_batches(docs.sparkSession, "4m")
    usable = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("__high"))
        .where("y = __high").select(F.col("doc_id").alias("__labelled"), "y")
    )
    total = usable.count()
    if total > max_train:
        usable = usable.where(F.pmod(F.xxhash64("__labelled"), F.lit(1_000_000)) < int(1_000_000 * max_train / total))

    def rows_of(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [features(d).tobytes() for d in pdf["data"]]})

    # In the order of a hash: the fit doesn't depend on how Spark dealt the rows.
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = cut(
        docs.select("doc_id", text_bytes().alias("data")).join(F.broadcast(usable), F.col("doc_id") == F.col("__labelled"))
        .select("doc_id", "y", "data").mapInPandas(rows_of, "doc_id long, y int, x binary").withColumn("order", order)
    )
    sizes = rows.select("order", F.octet_length("x").alias("bytes")).orderBy("order", "doc_id", "bytes").limit(2 * max_train).toPandas()
    fits = sizes["order"][sizes["bytes"].cumsum() <= max_bytes]
    last = int(fits.iloc[-1]) if len(fits) else -1
    if len(fits) < len(sizes):
        last = min(last, int(sizes["order"].iloc[len(fits)]) - 1)
    rows, stored = rows.where(F.col("order") <= last).toArrow().to_pandas(), rows
    discard(stored)
    rows = rows.sort_values(["order", "doc_id", "x"], kind="stable").head(2 * max_train)
    return fit([np.frombuffer(x, np.int32) for x in rows["x"]], rows["y"].to_numpy())


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus its ``score`` (in place of a column of that name): every row, whole texts, one pass."""
    small_batches(docs.sparkSession, "4m")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(d) for d in batches], dtype="float64")

    return docs.drop("score").withColumn("score", score(text_bytes()))


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3)."""
    model = train(docs, labels, max_train=max_train)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows that the classifier doesn't reject, all columns unchanged."""
    model = train(docs, labels, max_train=max_train)
    names = docs.columns
    scored = with_scores(docs.withColumnRenamed("score", "__own_score") if "score" in names else docs, model).where(F.col("score") >= THRESHOLD).drop("score")
    return (scored.withColumnRenamed("__own_score", "score") if "score" in names else scored).select(*names)
