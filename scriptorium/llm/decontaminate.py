"""Benchmark decontamination: a prefix-filtered set join of benchmark windows and documents (DataFrame functions only).

A benchmark text is cut into windows of ``WINDOW`` consecutive words (a shorter
text is one window); a window is contained in a document if its words occur
there in a row.  Every shingle of a contained window then occurs in the
document, so a prefix of one shingle per window is enough to find it, and the
rarest one finds it with the fewest candidates:

1. Count the benchmark's shingles over all documents (partial counts per task).
2. Order the shingles of each window by that count; the rarest is its prefix.
3. Join the prefixes with the documents' shingles by hash.  A hit at a word
   fixes where the window would start (positional bound) and must leave room for
   all its words (length bound); what is left is verified word for word on a
   slice of the window's size.

Windows are taken once, however many items share them, and join their items at
the end, by distinct sets of windows.  If the benchmark measures small, its
shingles and windows are broadcast and documents are scanned without a shuffle
of their words; beyond ``BROADCAST_BYTES`` the same joins run shuffled, on
hashes, and texts come back only for the candidates of their document.

Defined results: null texts have no words; a row is a document, so rows repeated
with one ``doc_id`` come out repeatedly, each with the hits of its own text; a
null ``doc_id`` is kept; benchmark rows that share an ``item_id`` are one item;
a null ``item_id`` hits words but is no item to count or to name; documents
without hits have the digest of the empty list; empty tables give empty
results, or documents without hits; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Bytes of the distinct windows' words up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Everything in ASCII but digits and lower-case letters parts words; capitals are lowered before.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The text's words with A-Z lowered (a pure ASCII text by ``lower``, others letter by letter)."""
    whole = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, GAP), "")


def _shingle_at(words: Column, at: Column, width: int) -> Column:
    """Hash of ``width`` words from the 0-based position on."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + i) for i in range(width)])


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (window_id, window, length), and (window_id, item_id)."""
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    own = texts.where(F.size("words") > 0).select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at") + 1, window).alias("window"))
    # 128 bits of a digest name a window.
    named = own.select("item_id", F.sha2(F.to_json("window"), 256).substr(1, 32).alias("window_id"), "window")
    return named.groupBy("window_id").agg(F.first("window").alias("window")).withColumn("length", F.size("window")), named.select("window_id", "item_id").distinct()


def _shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """(window_id, length, at, width, token): the shingles of each window; one shorter than a shingle is one."""
    width = F.least(F.col("length"), F.lit(shingle))
    placed = windows.select("window_id", "window", "length", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("length") - width)).alias("at"))
    token = F.coalesce(*[F.when(F.col("width") == w, _shingle_at(F.col("window"), F.col("at"), w)) for w in range(1, shingle + 1)])
    return placed.select("window_id", "length", "at", "width", token.alias("token"))


def _document_shingles(docs: DataFrame, widths: list[int], ends: bool = False) -> DataFrame:
    """Each document's shingles (pos, token) of the given widths; with ``ends`` also a row without token at pos = n_words."""
    n = F.col("n_words")
    rows = docs.select("*", F.explode(F.sequence(F.lit(0), n)).alias("pos"))
    if len(widths) > 1:
        rows = rows.select("*", F.explode(F.array(*map(F.lit, widths))).alias("width"))
        kind = F.col("width")
    else:
        kind = F.lit(widths[0])
    token = F.coalesce(*[F.when((kind == w) & (F.col("pos") + w <= n), _shingle_at(F.col("words"), F.col("pos"), w)) for w in widths])
    rows = rows.select(*docs.columns, "pos", token.alias("token"), kind.alias("width"))
    # The end is a row of its own for one width only.
    return rows.where(F.col("token").isNotNull() | ((F.col("pos") == n) & (F.col("width") == widths[0])) if ends else F.col("token").isNotNull()).drop("width")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows, owners = benchmark_windows(items, window)
    windows = cut(windows)
    owners = cut(owners)
    listed = _shingles_of(windows, shingle)
    measured = windows.agg(F.sum(F.octet_length(F.array_join("window", " ")) + 16 * F.col("length")).alias("bytes"), F.collect_set(F.least("length", F.lit(shingle))).alias("widths")).first()
    small, widths = (measured.bytes or 0) <= broadcast_bytes, sorted(measured.widths) or [shingle]

    # The same text under the same doc_id gives the same hits, so the two name a document.
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    texts = texts.withColumn("n_words", F.size("words"))
    tokens, seen = listed.select("token").distinct(), _document_shingles(texts.select("words", "n_words"), widths).select("token")
    if small:
        rarity = seen.join(F.broadcast(tokens), "token").groupBy("token").agg(F.count("*").alias("seen"))
    else:  # counts first, so that no frequent shingle is a hot key of the join
        rarity = seen.groupBy("token").agg(F.count("*").alias("seen")).join(tokens, "token")
    order = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "at", "token")
    prefix = cut(listed.join(cut(rarity), "token", "left").groupBy("window_id", "length").agg(F.min(order).alias("rarest")).where("rarest.seen > 0").select("window_id", "length", "rarest.at", "rarest.token"))

    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    same = F.slice("words", start + 1, F.col("length")) == F.col("window")
    hit = [F.col("doc_id"), F.col("text_key"), F.col("n_words"), start.alias("start"), F.col("length"), F.col("window_id")]
    end = [F.col("doc_id"), F.col("text_key"), F.col("n_words"), F.col("n_words").alias("start"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("window_id")]
    if small:
        probes = F.broadcast(prefix.join(windows.select("window_id", "window"), "window_id").withColumnRenamed("token", "prefix"))
        rows = _document_shingles(texts, widths, ends=True).join(probes, (F.col("token") == F.col("prefix")) & fits & same, "left")
        found = rows.where(F.col("window_id").isNotNull() | F.col("token").isNull()).select(
            *hit[:3], F.coalesce(hit[3], "pos").alias("start"), F.coalesce("length", F.lit(0)).alias("length"), "window_id"
        )
    else:
        candidates = _document_shingles(texts, widths).select("doc_id", "text_key", "n_words", "pos", "token").join(prefix, "token").where(fits).select(*hit).distinct()
        of = lambda df: df.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "start", "length", "window_id")
        met = texts.join(of(candidates), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")))
        verified = met.join(windows.select("window_id", "window"), "window_id").where(F.slice("words", F.col("start") + 1, F.col("length")) == F.col("window"))
        found = texts.select(*end).union(verified.select("doc_id", "text_key", "n_words", "start", "length", "window_id"))
    return _per_document(found, owners)


def _per_document(found: DataFrame, owners: DataFrame) -> DataFrame:
    """Documents from their hits (doc_id, text_key, n_words, start, length, window_id) and end rows (length 0, one for each time the row occurs)."""
    key = ["doc_id", "text_key"]
    hits = found.groupBy(*key, "n_words", "start", "length", "window_id").agg(F.count("*").alias("times"))
    before = Window.partitionBy(*key).orderBy("start", "length", "window_id").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))).cast("long")
    rows = hits.withColumn("covered", covered).groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("covered").alias("n_hit"), F.sort_array(F.collect_set("window_id")).alias("windows"), F.max(F.when(F.col("length") == 0, F.col("times"))).alias("times"),
    )
    rows = cut(rows.select("doc_id", "n_words", "n_hit", "times", "windows", F.xxhash64("windows").alias("set_key")))
    sets = rows.where(F.size("windows") > 0).select("set_key", "windows").distinct()
    named = (
        sets.select("set_key", "windows", F.explode("windows").alias("window_id")).join(owners.where("item_id is not null"), "window_id")
        .groupBy("set_key", "windows").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        .select(F.col("set_key").alias("of_set"), F.col("windows").alias("of_windows"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    )
    # Written first, so that the join's sides are plain tables and a set that very many documents share can be split.
    named = cut(named)
    hit = rows.where(F.size("windows") > 0).join(named, (F.col("set_key") == F.col("of_set")) & (F.col("windows") == F.col("of_windows")), "left")
    none = rows.where(F.size("windows") == 0)
    result = lambda df, n, digest: df.select("doc_id", "n_words", "n_hit", n.alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "times")
    no_items, no_digest = F.lit(0).cast("long"), F.sha2(F.lit(""), 256)
    out = result(hit, F.coalesce("n_items", no_items), F.coalesce("items_sha256", no_digest)).union(result(none, no_items, no_digest))
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "col")
