"""Quote verification: exact, normalised, near, not found, no canonical text.

Quotes meet documents through shared probe words rather than a cross join: a
document that holds a quote, or at least the first ``NEAR_SHARE`` of it, holds
every inner word of that beginning as a whole word.  The longest of these is
looked up in the documents' words, and only those documents are searched.
Quotes whose beginning has no inner word are held against all documents, in
blocks.  A quote that names its document joins on the id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from scriptorium.functions import text as T
from scriptorium.session import bounded_batches

NEAR_SHARE, CONTEXT = 0.5, 80
#: Characters around a window that are searched with it, beside the length of the quote.
WINDOW_SLACK = 256
#: Probe words up to which they are a literal of the plan.
LITERAL_PROBES = 1000
#: Quotes without a probe word that meet the documents in one pass.
UNPROBED_BLOCK = 10_000


def probes(quotes: DataFrame) -> DataFrame:
    """``quotes(quote_id, quote)`` plus ``head``, the first ``NEAR_SHARE`` of the folded quote, and ``probe``, its longest inner word (its ends may be cut words)."""
    folded = T.fold(F.col("quote"))
    headed = quotes.withColumn("head", F.substring(folded, F.lit(1), F.ceil(F.length(folded) * NEAR_SHARE).cast("int")))
    words = T.words(F.col("head"))
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return headed.withColumn("probe", longest["w"])


def candidates(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote_id, quote, doc_id, text) of all documents that may hold a quote or the first ``NEAR_SHARE`` of it."""
    probed = probes(quotes.select("quote_id", "quote"))
    pairs = _by_probe(probed.where("probe is not null").drop("head"), docs)
    return pairs.unionByName(_unprobed(probed.where("probe is null and quote is not null").drop("probe"), docs))


def _unprobed(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """As :func:`candidates` for quotes without a probe word: every document is searched for each of them."""
    blocks = -(-asked.count() // UNPROBED_BLOCK)
    texts = docs.select("doc_id", "text", T.fold(F.col("text")).alias("folded"))
    held = F.contains("text", F.col("quote")) | (F.contains("folded", F.col("head")) & (F.col("head") != ""))
    out = docs.sparkSession.createDataFrame([], asked.select("quote_id", "quote").join(docs.select("doc_id", "text").limit(0)).schema)
    for n in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("quote_id", "quote"), F.lit(blocks)) == n)
        out = out.unionByName(texts.join(F.broadcast(block), held).select("quote_id", "quote", "doc_id", "text"))
    return out


def _by_probe(probed: DataFrame, docs: DataFrame) -> DataFrame:
    """As :func:`candidates` for quotes with a probe word, through the documents that hold it."""
    wanted = probed.select("probe").distinct()
    own = T.words(T.fold(F.col("text")))
    few = [r["probe"] for r in wanted.limit(LITERAL_PROBES + 1).collect()]
    if len(few) <= LITERAL_PROBES:
        # A bounded set of probes is a literal: documents are searched while they are scanned.
        hits = F.array_intersect(own, F.array(*[F.lit(w) for w in few]).cast("array<string>"))
        found = docs.select("doc_id", "text", F.explode(hits).alias("probe")).join(probed, "probe")
        return found.select("quote_id", "quote", "doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(own)).alias("probe")).join(wanted, "probe", "left_semi")
    pairs = probed.join(words, "probe").select("quote_id", "quote", "doc_id")
    return pairs.join(docs.select("doc_id", "text"), "doc_id")


def match(pairs: DataFrame, verbatim: bool = True) -> DataFrame:
    """Per (quote, document): tier (0 exact, 1 normalised) and offset, JVM-side; other pairs are left out.

    Without ``verbatim`` there is no tier 0.
    """
    at = T.locate0(F.col("text"), F.col("quote")) if verbatim else F.lit(None).cast("int")
    folded = T.locate0(T.fold(F.col("text")), T.fold(F.col("quote")))
    exact = pairs.withColumn("exact", at)
    hit = F.when(F.col("exact").isNotNull(), F.struct(F.lit(0).alias("tier"), F.col("exact").alias("at"))).otherwise(F.struct(F.lit(1).alias("tier"), folded.alias("at")))
    return exact.select("quote_id", "doc_id", hit.alias("h")).where("h.at is not null").select("quote_id", "doc_id", "h.tier", "h.at")


_HIT = Ty.StructType([
    Ty.StructField("share", Ty.DoubleType()), Ty.StructField("char_start", Ty.IntegerType()), Ty.StructField("char_end", Ty.IntegerType()), Ty.StructField("context", Ty.StringType())
])


@F.pandas_udf(_HIT)
def folded_hit(texts: pd.Series, quotes: pd.Series) -> pd.DataFrame:
    """Longest beginning of a folded quote that a folded text holds (bisection): its share, its raw span, and the text where they part.

    A null text or an empty quote has share 0 and no span.
    """
    rows, last, folded = [], None, ""
    for text, quote in zip(texts, quotes, strict=True):
        if text is None or pd.isna(text):
            rows.append((0.0, None, None, None))
            continue
        if text is not last and text != last:  # a document's quotes come one after the other
            folded, last = T.folded_text(text), text
        want = T.folded_text(quote or "")
        low, high = (len(want), len(want)) if want in folded else (0, len(want))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if want[:mid] in folded else (low, mid - 1)
        if not low:
            rows.append((0.0, None, None, None))
            continue
        at = folded.find(want[:low])
        starts = T.fold_with_offsets(text, at + low)[1]  # offsets are traced no further than the hit
        end = starts[at + low - 1] + 1
        rows.append((low / len(want), starts[at], end, text[end : end + CONTEXT]))
    hits = pd.DataFrame(rows, columns=["share", "char_start", "char_end", "context"])
    return hits.astype({"char_start": "Int32", "char_end": "Int32"})


def exact(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote_id, doc_id) of the first document that holds each quote as it stands; other quotes are left out."""
    held = candidates(quotes, docs).where(F.contains("text", F.col("quote")))
    return held.groupBy("quote_id").agg(F.min("doc_id").alias("doc_id"))


def verify(quotes: DataFrame, docs: DataFrame, verbatim: bool = True) -> DataFrame:
    """Per quote: quote_id, verdict, doc_id, char_start (raw); exact before normalised, then the smallest doc_id; near by the longest beginning.

    Quotes that are not ``verbatim`` (known to be retyped, say in capitals) are normalised at best: that a document
    happens to hold the retyped form doesn't set it before a smaller doc_id.

    Of a normalised hit that can't be traced to a raw offset (combining marks), char_start is null.
    """
    asked = quotes.where(T.collapse_space(F.col("quote")) != "")  # an empty quote is never found
    pairs = candidates(asked, docs)
    best = F.min(F.struct("tier", "doc_id", "at")).alias("b")
    found = match(pairs, verbatim).groupBy("quote_id").agg(best)
    # The winners' texts alone are traced back to raw offsets.
    folded = found.where("b.tier = 1").select("quote_id", "b.doc_id").join(asked.select("quote_id", "quote"), "quote_id").join(docs.select("doc_id", "text"), "doc_id")
    raw = folded.select("quote_id", folded_hit("text", "quote").alias("r")).where("r.share = 1").groupBy("quote_id").agg(F.min("r.char_start").alias("raw"))
    # Only documents that hold the first half of a quote can be near; that is tested before texts leave the JVM.
    rest = probes(pairs.join(found, "quote_id", "left_anti")).where(F.contains(T.fold(F.col("text")), F.col("head")))
    tried = rest.select("quote_id", "doc_id", folded_hit("text", "quote").alias("p")).where(F.col("p.share") >= NEAR_SHARE)
    near = tried.groupBy("quote_id").agg(F.min(F.struct((-F.col("p.share")).alias("s"), "doc_id", F.col("p.char_start").alias("at"))).alias("n"))
    verdict = F.when(F.col("b.tier") == 0, "exact").when(F.col("b.tier") == 1, "normalized").when(F.col("n").isNotNull(), "near").otherwise("not_found")
    at = F.when(F.col("b.tier") == 0, F.col("b.at")).when(F.col("b.tier") == 1, F.col("raw")).otherwise(F.col("n.at"))
    joined = quotes.select("quote_id").join(found, "quote_id", "left").join(raw, "quote_id", "left").join(near, "quote_id", "left")
    return joined.select("quote_id", verdict.alias("verdict"), F.coalesce("b.doc_id", "n.doc_id").alias("doc_id"), at.alias("char_start"))


def verify_in_document(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Quotes that name their document, ``requests(quote_id, quote, doc_id[, window_start, window_end])``, against its text.

    Returns quote_id, doc_id, verdict, char_start, char_end, share, context.  A window is where the quote is thought to
    stand: it and some characters around it are searched first, then the whole text.  ``share`` is how much of the quote
    the text holds from its beginning on (1 if all), ``context`` what the text says where a near quote departs from it.
    A document without text is its own verdict.
    """
    bounded_batches(docs.sparkSession)
    for c in ("window_start", "window_end"):
        requests = requests if c in requests.columns else requests.withColumn(c, F.lit(None).cast("int"))
    asked = requests.select("quote_id", "doc_id", F.trim("quote").alias("quote"), "window_start", "window_end")
    joined = asked.join(docs.select("doc_id", "text"), "doc_id", "left")
    slack = F.length("quote") + WINDOW_SLACK
    low = F.greatest(F.col("window_start") - slack, F.lit(0))
    around = joined.withColumn("low", low).withColumn("around", T.slice_span(F.col("text"), low, F.col("window_end") + slack))
    stands = F.when(F.col("quote") != "", F.lit(True))
    exactly = around.select("*", F.when(stands, T.locate0(F.col("around"), F.col("quote")) + F.col("low")).alias("near_at"), F.when(stands, T.locate0(F.col("text"), F.col("quote"))).alias("at"))
    # Only what isn't found as it stands is folded, and the window before the whole text.
    first = exactly.withColumn("w", folded_hit(F.when(F.col("near_at").isNull(), F.col("around")), "quote"))
    whole = first.withColumn("f", folded_hit(F.when(F.col("near_at").isNull() & (F.col("w.share") < 1) & F.col("at").isNull(), F.col("text")), "quote"))
    span = lambda tier, start, end, share, context: F.struct(F.lit(tier).alias("verdict"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), share.alias("share"), context.alias("context"))
    none, one, n = F.lit(None).cast("string"), F.lit(1.0), F.length("quote")
    hit = (
        F.when(F.col("text").isNull(), span("no_canonical_text", F.lit(None), F.lit(None), F.lit(None).cast("double"), none))
        .when(F.col("near_at").isNotNull(), span("exact", F.col("near_at"), F.col("near_at") + n, one, none))
        .when(F.col("w.share") == 1, span("normalized", F.col("w.char_start") + F.col("low"), F.col("w.char_end") + F.col("low"), one, none))
        .when(F.col("at").isNotNull(), span("exact", F.col("at"), F.col("at") + n, one, none))
        .when(F.col("f.share") == 1, span("normalized", F.col("f.char_start"), F.col("f.char_end"), one, none))
        .when(F.col("f.share") >= NEAR_SHARE, span("near", F.col("f.char_start"), F.col("f.char_end"), F.col("f.share"), F.col("f.context")))
        .otherwise(span("not_found", F.lit(None), F.lit(None), F.coalesce(F.col("f.share"), F.lit(0.0)), none))
    )
    return whole.select("quote_id", "doc_id", hit.alias("h")).select("quote_id", "doc_id", "h.*")
