"""Source divergence audit: how the term frequencies of each source differ from other sources of its language.

Sort-based streaming.  Tasks count terms over blocks of documents and send
(lang, term, source, block, documents, occurrences) rows; these are
repartitioned by (lang, term) and sorted by (lang, term, source, block).  A
run-length scan adds each run up to document frequency and counts and passes on
the terms that enough documents hold.  Once the totals are known, a second scan
over the kept rows in the same order emits, for each run, partial pairs (a
correction for the sources that share the term) and the terms that a source has
more often than its language.

A pair's value is a sum over all kept terms, most of which most sources lack.
With p0 the frequency of an absent term, f(p, q) over all terms is
V * f(p0, p0), plus what changes where the one source has the term, plus what
changes where the other has it (both from a histogram of counts), plus the
partial pairs where both have it.  So work follows the occurrences, not terms
times sources squared.  All arithmetic is on integers.

No state grows with the corpus: a block is bounded by its distinct terms, a run
by the number of sources, and partial results leave a task when they reach a
bound.  A hot term has at most one row a block and source.

Defined results: null text, lang and source count as ''; a row is a document, so
rows repeated with one ``doc_id`` count each; a language without kept terms has
its pairs with value 0 and no terms; a language of one source has no rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, small_batches, text_bytes

#: Documents of a language that must hold a term; ranks of terms that are reported; the scale of frequencies.
LEAST_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Entries of a block, rows of terms and of pairs that a task holds, pairs that are expanded at once, bytes of text that are cut into words at once.
BLOCK, HELD, EXPAND, PIECE = 600_000, 200_000, 500_000, 1 << 20
#: Letters and everything beyond ASCII, in bytes; a text is cut only between such runs.
_TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
_COUNTS = "lang string, term binary, source string, block int, docs long, n long"
_KEPT = "lang string, term binary, source string, n long"
_FOUND = "part string, lang string, source string, item binary, value long"


class _Ids(dict):
    """Numbers for keys, in the order in which they are met."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def term_ids(data: bytes, ids: _Ids) -> np.ndarray:
    """The numbers of the terms of a whole text, in order; long texts go through in pieces."""
    data, parts, at = data.lower(), [], 0  # bytes: A-Z only
    while at < len(data):
        gap = _GAP.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = gap.start() if gap else len(data)
        words = _TERM.findall(data, at, end)
        parts.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], *[np.add.reduceat(v[order], start) if len(start) else v for v in values]


def _count_blocks(batches):
    """Rows of ``_COUNTS`` from batches of (lang, source, data)."""
    number = 0
    ids, groups, held = _Ids(), _Ids(), []

    def merged():
        return summed(*[np.concatenate(x) for x in zip(*held, strict=True)])

    def rows():
        nonlocal number
        keys, docs, n = merged()
        names, words = list(groups), pa.array(list(ids), pa.binary())
        group = keys >> 32
        for at in range(0, len(keys), 50_000):
            part = slice(at, at + 50_000)
            own = pa.array(group[part])
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in names], pa.string()).take(own), words.take(pa.array(keys[part] & 0xFFFFFFFF)), pa.array([x[1] for x in names], pa.string()).take(own),
                pa.array(np.full(len(own), number, np.int32)), pa.array(docs[part]), pa.array(n[part]),
            ], names=["lang", "term", "source", "block", "docs", "n"])
        number += 1
        held.clear()
        ids.clear()
        groups.clear()

    for batch in batches:
        texts = batch.column("data")
        for at in range(0, len(texts), 256):
            parts, where, owner = [], [], []
            for k in range(at, min(len(texts), at + 256)):
                found = term_ids(texts[k].as_py(), ids)
                owner.append(groups[batch.column("lang")[k].as_py(), batch.column("source")[k].as_py()])
                parts.append(found)
                where.append(np.full(len(found), k - at, np.int64))
            codes, n = np.unique(np.concatenate(where) << 32 | np.concatenate(parts), return_counts=True)
            keys = np.array(owner, np.int64)[codes >> 32] << 32 | (codes & 0xFFFFFFFF)
            held.append(summed(keys, np.ones(len(keys), np.int64), n))
            if sum(len(x[0]) for x in held) > 2 * BLOCK:
                held[:] = [merged()]
                if len(held[0][0]) > BLOCK:
                    yield from rows()
    if held:
        yield from rows()


def _starts(*columns: pa.Array) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return new


def _whole_runs(batches, add=None):
    """Tables that end where a (lang, term) run ends, from batches sorted by it; ``add`` shortens a table first."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
        if not len(table):
            continue
        if add:
            table = add(table)
        last = int(np.flatnonzero(_starts(table["lang"].combine_chunks(), table["term"].combine_chunks()))[-1])
        if last:
            yield table.slice(0, last).combine_chunks()
        rest = table.slice(last)
    if rest is not None and len(rest):
        yield rest.combine_chunks()


def _add_blocks(table: pa.Table) -> pa.Table:
    """One row for each (lang, term, source) of a sorted table."""
    start = np.flatnonzero(_starts(*[table[c].combine_chunks() for c in ("lang", "term", "source")]))
    sums = [pa.array(np.add.reduceat(table[c].to_numpy(), start)) for c in ("docs", "n")]
    return pa.table([*[table[c].take(pa.array(start)) for c in ("lang", "term", "source")], *sums], names=["lang", "term", "source", "docs", "n"])


def _kept_runs(least: int):
    def scan(batches):
        for table in _whole_runs((b.select(["lang", "term", "source", "docs", "n"]) for b in batches), _add_blocks):
            start = np.flatnonzero(_starts(table["lang"].combine_chunks(), table["term"].combine_chunks()))
            frequency = np.add.reduceat(table["docs"].to_numpy(), start)
            keep = np.repeat(frequency >= least, np.diff(np.append(start, len(table))))
            yield from table.filter(pa.array(keep)).select(["lang", "term", "source", "n"]).to_batches(max_chunksize=50_000)

    return scan


def frequency(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / total), by long division in steps of 1000, so that nothing overflows."""
    rest, out = n + 1, np.zeros_like(n)
    whole, rest = np.divmod(rest, total)
    out += whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)"""
    return (p - q) ** 2 // q


def _pair_corrections(run: np.ndarray, size: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray):
    """(source << 32 | other, value) parts for all ordered pairs of rows of a run; ``run`` is each row's first row, ``size`` its run's rows."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + EXPAND)))
        n = size[at:end]
        a = np.repeat(np.arange(at, end), n)
        b = np.repeat(run[at:end], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        a, b = a[a != b], b[a != b]
        value = gap(p[a], p[b]) - gap(p[a], p0[b]) - gap(p0[a], p[b]) + gap(p0[a], p0[b])
        yield summed(source[a] << 32 | source[b], value)
        at = end


def _best(table: pa.Table, top: int) -> pa.Table:
    """The ``top`` rows of each (lang, source) by value, ties to smaller items."""
    table = table.sort_by([("lang", "ascending"), ("source", "ascending"), ("value", "descending"), ("item", "ascending")])
    new = _starts(table["lang"].combine_chunks(), table["source"].combine_chunks())
    start = np.flatnonzero(new)
    return table.filter(pa.array(np.arange(len(table)) - start[np.cumsum(new) - 1] < top))


def _audit_runs(top: int):
    def scan(batches):
        names, held, lang = _Ids(), [], None
        terms: list[pa.Table] = []

        def pairs():
            if not held:
                return
            keys, values = summed(*[np.concatenate(x) for x in zip(*held, strict=True)])
            held.clear()
            known = pa.array(list(names), pa.string())
            for at in range(0, len(keys), 50_000):
                k = keys[at : at + 50_000]
                yield batch_of("pair", pa.array([lang] * len(k), pa.string()), known.take(pa.array(k >> 32)), known.take(pa.array(k & 0xFFFFFFFF)).cast(pa.binary()), values[at : at + 50_000])

        def batch_of(part, lang, source, item, value):
            return pa.RecordBatch.from_arrays([pa.array([part] * len(value), pa.string()), lang, source, item, pa.array(value)], names=["part", "lang", "source", "item", "value"])

        for whole in _whole_runs(batches):
            new_lang = np.flatnonzero(_starts(whole["lang"].combine_chunks()))
            for first, end in zip(new_lang, [*new_lang[1:], len(whole)], strict=True):
                table = whole.slice(first, end - first).combine_chunks()
                if table["lang"][0].as_py() != lang:
                    yield from pairs()
                    names.clear()
                    lang = table["lang"][0].as_py()
                start = np.flatnonzero(_starts(table["term"].combine_chunks()))
                size = np.diff(np.append(start, len(table)))
                n, v, total, whole_total = (table[c].to_numpy() for c in ("n", "v", "total", "lang_total"))
                p, p0 = frequency(n, total + v), frequency(np.zeros_like(n), total + v)
                q = np.repeat(frequency(np.add.reduceat(n, start), (whole_total + v)[start]), size)
                more = np.flatnonzero(p > q)
                take = pa.array(more)
                terms.append(pa.table([table["lang"].take(take), table["source"].take(take), table["term"].take(take), pa.array(gap(p[more], q[more]))], names=["lang", "source", "item", "value"]))
                if sum(map(len, terms)) > HELD:
                    terms[:] = [_best(pa.concat_tables(terms), top)]
                    if len(terms[0]) > HELD // 2:
                        yield from (batch_of("term", *b.columns[:3], b.column(3).to_numpy()) for b in terms.pop().to_batches(max_chunksize=50_000))
                codes = table["source"].combine_chunks().dictionary_encode()
                own = np.array([names[x] for x in codes.dictionary.to_pylist()], np.int64)[codes.indices.to_numpy()]
                for part in _pair_corrections(np.repeat(start, size), np.repeat(size, size), own, p, p0):
                    held.append(part)
                    if sum(len(x[0]) for x in held) > HELD:
                        held[:] = [summed(*[np.concatenate(x) for x in zip(*held, strict=True)])]
                        if len(held[0][0]) > HELD // 2:
                            yield from pairs()
        yield from pairs()
        if terms:
            yield from (batch_of("term", *b.columns[:3], b.column(3).to_numpy()) for b in _best(pa.concat_tables(terms), top).to_batches(max_chunksize=50_000))

    return scan


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n): occurrences of each term that at least ``least`` documents of its language hold."""
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    counts = docs.select(name("lang"), name("source"), text_bytes().alias("data")).mapInArrow(_count_blocks, _COUNTS)
    # The same runs as with the language first, but a term's first bytes tell most rows apart.
    return counts.repartition("lang", "term").sortWithinPartitions("term", "lang", "source", "block").mapInArrow(_kept_runs(least), _KEPT)


def _p(n: Column, total: Column) -> Column:
    return F.lit(1).cast("long") + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(UNIT), total.cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (part pair) and the ``top`` overrepresented terms (part term)."""
    small_batches(docs.sparkSession, "4m")
    kept = cut(kept_counts(docs, least))
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    hist = cut(kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")))
    occurring = docs.select(name("lang"), name("source")).distinct()
    totals = hist.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"))
    sizes = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    per_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(sizes, "lang")
    groups = cut(occurring.join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "lang_total", "v")]))

    rows = kept.join(groups, ["lang", "source"]).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    found = cut(rows.select("lang", "term", "source", "n", "total", "lang_total", "v").mapInArrow(_audit_runs(top), _FOUND))

    absent = groups.select("lang", "source", "v", F.when(F.col("v") > 0, _p(F.lit(0), F.greatest(F.col("total") + F.col("v"), F.lit(1)))).alias("p0"))
    pairs = absent.join(absent.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").where("source <> item")
    pairs = cut(pairs.withColumn("f0", _f(F.col("p0"), F.col("q0"))))
    steps = cut(hist.join(groups, ["lang", "source"]).select("lang", "source", "terms", _p(F.col("n"), F.col("total") + F.col("v")).alias("p")))
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("v") * F.col("f0"), F.lit(0)).alias("value"))
    own = pairs.join(steps, ["lang", "source"]).select("lang", "source", "item", (F.col("terms") * (_f(F.col("p"), F.col("q0")) - F.col("f0"))).alias("value"))
    other = pairs.join(steps.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", (F.col("terms") * (_f(F.col("p0"), F.col("p")) - F.col("f0"))).alias("value"))
    both = found.where("part = 'pair'").select("lang", "source", F.col("item").cast("string").alias("item"), "value")
    summed_pairs = base.union(own).union(other).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = found.where("part = 'term'").select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return summed_pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
