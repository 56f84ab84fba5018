"""Work files held against the corpus, and their bodies rendered with footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import quotes
from scriptorium.operators.revisions import MOST_QUOTED, NARROW, REGION_WARNED
from scriptorium.session import stored

#: How a footnote names the parts of a place; others go by their own name.
LOCATOR_WORDS = {"page": "p.", "chapter": "ch.", "verse": "v."}


def entries(works: DataFrame) -> DataFrame:
    """One row a valid citation: path, marked (its mark stands in the body), and the citation's fields."""
    rows = works.where("error is null").select("path", "markers", F.posexplode("citations").alias("nth", "c"))
    return rows.select("path", "nth", F.array_contains("markers", F.col("c.id")).alias("marked"), "c.*")


def checked(works: DataFrame, documents: DataFrame, texts: DataFrame, passages: DataFrame) -> DataFrame:
    """:func:`entries` with ``document_known``, ``document_key``, and how the quotation verifies: verdict, found_start, found_end, region."""
    own = entries(works).withColumn("quote_id", F.struct("path", "nth"))
    asked = own.select("quote_id", F.col("quoted_text").alias("quote"), F.col("document_id").alias("doc_id"), F.col("char_start").alias("window_start"), F.col("char_end").alias("window_end"))
    held = quotes.verify_in_document(asked, texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    held = held.select("quote_id", "verdict", F.col("char_start").alias("found_start"), F.col("char_end").alias("found_end"))
    known = documents.select(F.col("doc_id").cast("string").alias("document_id"), F.col("edition_key").alias("document_key"), F.lit(True).alias("document_known"))
    regions = passages.select(F.col("doc_id").cast("string").alias("document_id"), "char_start", "char_end", F.lit(True).alias("region")).distinct()
    return own.join(held, "quote_id").join(known, "document_id", "left").join(regions, ["document_id", "char_start", "char_end"], "left").drop("quote_id")


def entry_findings(rows: DataFrame, publish: bool = False) -> DataFrame:
    """Findings of each of :func:`checked`, in order, up to its first error: path, rule, severity, citation_id, detail."""
    c = F.col
    region = F.coalesce(c("region"), F.lit(False))
    keyless = c("edition_key").isNull() & c("edition").isNull()
    steps = [
        ("AUTH_DOCUMENT_UNKNOWN", "error", c("document_known").isNull(), c("document_id")),
        ("AUTH_SOURCE_UNCHECKABLE", "error", c("verdict") == "no_canonical_text", c("document_id")),
        ("AUTH_QUOTE_UNVERIFIED", "error", c("verdict").isin("near", "not_found"), c("verdict")),
        ("AUTH_SOURCE_SPAN_STALE", "error", ~(c("found_start").eqNullSafe(c("char_start")) & c("found_end").eqNullSafe(c("char_end"))), F.concat_ws("-", "found_start", "found_end")),
        ("AUTH_SPAN_NOT_NARROWED", "error", c("intent").isin(*NARROW) & (region | (c("char_end") - c("char_start") > MOST_QUOTED)), None),
        ("AUTH_SPAN_REGION", "warning", c("intent").isin(*REGION_WARNED) & region, None),
        ("AUTH_CITATION_EDITION_MISSING", "error" if publish else "warning", keyless, None),
        ("AUTH_EDITION_KEY_UNKNOWN", "warning", c("edition_key").isNotNull() & c("document_key").isNull(), c("edition_key")),
        ("AUTH_EDITION_KEY_MISMATCH", "error", c("edition_key") != c("document_key"), c("document_key")),
        ("AUTH_CITATION_MARKER_MISSING", "warning", ~c("marked"), None),
    ]
    # A missing edition doesn't end an entry's checks, though at publication it is an error.
    ends = [rule for rule, severity, _, _ in steps if severity == "error" and rule != "AUTH_CITATION_EDITION_MISSING"]
    none = F.lit(None).cast("string")
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (none if detail is None else detail.cast("string")).alias("detail"))) for rule, severity, test, detail in steps]), lambda x: x.isNotNull())
    stops = F.transform("found", lambda x: x["rule"].isin(*ends))
    upto = F.coalesce(F.nullif(F.array_position(stops, True), F.lit(0)), F.size("found"))
    cut = rows.withColumn("found", found).select("path", "id", F.explode(F.slice("found", F.lit(1), upto.cast("int"))).alias("f"))
    return cut.select("path", "f.rule", "f.severity", F.col("id").alias("citation_id"), "f.detail")


def verify(works: DataFrame, documents: DataFrame, texts: DataFrame, passages: DataFrame, claims: DataFrame, publish: bool = False) -> DataFrame:
    """All findings of work files: path, rule, severity, citation_id, detail.

    ``documents(doc_id, edition_key)``, ``texts(doc_id, text)``, ``passages(doc_id, char_start, char_end)``, ``claims(ref)``.
    """
    good = works.where("error is null")
    row = lambda df, rule, citation, detail: df.select("path", F.lit(rule).alias("rule"), F.lit("error").alias("severity"), citation.alias("citation_id"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    invalid = row(good.select("path", F.explode("entry_errors").alias("e")), "AUTH_ENTRY_INVALID", F.col("e.id"), F.col("e.message"))
    named = F.array_union(F.transform("citations", lambda x: x["id"]), F.transform("entry_errors", lambda x: x["id"]))
    dangling = row(good.select("path", F.explode(F.filter("markers", lambda m: ~F.coalesce(F.array_contains(named, m), F.lit(False)))).alias("m")), "AUTH_CITATION_MARKER_DANGLING", F.col("m"), none)
    refs = good.select("path", F.explode("claims").alias("ref")).join(claims.select("ref").distinct(), "ref", "left_anti")
    # Written once, as the last rule reads the findings of the others: quotations are searched for once.
    out = stored(invalid.unionByName(entry_findings(checked(works, documents, texts, passages), publish)).unionByName(dangling).unionByName(row(refs, "AUTH_CLAIM_UNRESOLVED", none, F.col("ref"))))
    failing = out.where("severity = 'error' or rule = 'AUTH_CITATION_EDITION_MISSING'").select("path").distinct()
    return out.unionByName(row(good.where("status = 'published'").join(failing, "path", "left_semi"), "AUTH_STATUS_UNEARNED", none, none))


def gate(works: DataFrame, findings: DataFrame, publish: bool = False) -> DataFrame:
    """(path, passed, blockers) of each readable work."""
    blocking = (F.col("severity") == "error") | ((F.col("rule") == "AUTH_CITATION_EDITION_MISSING") & F.lit(publish))
    blockers = findings.where(blocking).groupBy("path").agg(F.sort_array(F.collect_set("rule")).alias("blockers"))
    return works.where("error is null").select("path").join(blockers, "path", "left").select("path", F.col("blockers").isNull().alias("passed"), F.coalesce("blockers", F.expr("cast(array() as array<string>)")).alias("blockers"))


def year_of(value: Column) -> Column:
    """The year that a date begins with, else the value as it is; null if it is blank."""
    bare = F.trim(value.cast("string"))
    return F.when(F.regexp_like(bare, F.lit(r"^\d{4}(\D|$)")), F.substring(bare, 1, 4)).otherwise(F.nullif(bare, F.lit("")))


def footnotes(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Footnotes of :func:`checked`: path, id, text, provisional, tier.

    ``documents(doc_id, author, title, year)``: what is unknown is named by its document, and such a note is provisional.
    """
    held = documents.select(F.col("doc_id").cast("string").alias("document_id"), "author", "title", year_of(F.col("year")).alias("year"))
    joined = rows.join(held, "document_id", "left")
    unnamed = F.concat(F.lit("document "), "document_id")
    words = F.create_map(*[F.lit(x) for pair in LOCATOR_WORDS.items() for x in pair])
    rest = F.filter(F.map_entries(F.coalesce("locator", F.expr("map()").cast("map<string,string>"))), lambda x: x["key"] != "volume")
    places = F.array_join(F.transform(rest, lambda x: F.concat(F.lit(", "), F.coalesce(F.try_element_at(words, x["key"]), x["key"]), F.lit(" "), x["value"])), "")
    after = lambda value, form: F.when(value.isNotNull(), F.format_string(form, value)).otherwise("")
    provisional = F.col("author").isNull() | F.col("title").isNull() | F.col("year").isNull()
    text = F.concat(
        F.coalesce("author", unnamed), F.lit(", "), F.coalesce(F.concat(F.lit("*"), "title", F.lit("*")), unnamed), after(F.col("edition"), ", %s"), after(F.try_element_at("locator", F.lit("volume")), ", vol. %s"), after(F.col("year"), " (%s)"), places,
        F.lit(". ["), "verdict", F.lit("]"), F.when(provisional, " [provisional]").otherwise(""),
    )
    return joined.select("path", "id", text.alias("text"), provisional.alias("provisional"), F.col("verdict").alias("tier"))


def rendered(works: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, text): bodies without written definitions, then their footnotes by number; a body without citations as it is."""
    listed = notes.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.substring("id", 2, 20).cast("long").alias("n"), "id", "text"))).alias("notes"))
    bare = F.regexp_replace(F.regexp_replace("body", r"(?m)^\[\^c\d+\]:[^\n]*\n?", ""), r"\s+$", "")
    lines = F.array_join(F.transform("notes", lambda x: F.concat(F.lit("[^"), x["id"], F.lit("]: "), x["text"])), "\n")
    return works.where("error is null").join(listed, "path", "left").select("path", F.when(F.col("notes").isNotNull(), F.concat(bare, F.lit("\n\n"), lines, F.lit("\n"))).otherwise(F.col("body")).alias("text"))
