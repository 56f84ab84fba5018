"""Reading around hits: windows bounded by structure, node prose, outlines, locations, slices.

Chains of ancestors come from the path's prefixes (an equi-join) and are reduced
to the few nodes that decide by aggregates, so any number of hits costs two
joins.  Texts are joined last, only to documents that have a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import spans

#: Characters a node may have to be read at once, and context around an anchor.
READ_CHARS, ANCHOR_CHARS = 120_000, 1200
_NODE = ["node_start", "node_end", "path"]


def chains(passages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(passage_id, path, title, node_start, node_end): the passage's own node and its ancestors.

    ``passages(passage_id, doc_id, path)`` with the path of its node; ``nodes(doc_id, path, title, node_start, node_end)``.
    """
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    asked = passages.where("path is not null").select("passage_id", "doc_id", F.explode(prefixes).alias("path"))
    return asked.join(nodes.select("doc_id", "path", "title", "node_start", "node_end"), ["doc_id", "path"]).drop("doc_id")


def locate(passages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per passage: passage_id, doc_id, path, citation (titles from the root down; null without structure or title), hits (passages of that node)."""
    titled = chains(passages, nodes).where("title is not null")
    crumbs = titled.groupBy("passage_id").agg(F.sort_array(F.collect_list(F.struct(F.length("path").alias("n"), "title"))).alias("c"))
    hits = passages.where("path is not null").groupBy("doc_id", "path").agg(F.count("*").alias("hits"))
    joined = passages.join(crumbs, "passage_id", "left").join(hits, ["doc_id", "path"], "left")
    return joined.select("passage_id", "doc_id", "path", F.array_join("c.title", " > ").alias("citation"), "hits")


def _centred(start: Column, end: Column, width: int, bound: Column) -> tuple[Column, Column]:
    """A span of ``width`` around another one, slid into ``bound`` (no node: into the text's beginning)."""
    low = F.coalesce(bound["node_start"], F.lit(0))
    first = F.greatest(F.floor((start + end) / 2) - width // 2, low)
    last = first + width
    over = bound["node_end"].isNotNull() & (last > bound["node_end"])
    return F.greatest(F.when(over, F.greatest(low, bound["node_end"] - width)).otherwise(first), F.lit(0)), F.when(over, bound["node_end"]).otherwise(last)


def choose_windows(passages: DataFrame, nodes: DataFrame, budget: int, least: int) -> DataFrame:
    """What to read around each passage: passage_id, doc_id, window_start, window_end, source, bound (a path).

    The widest node that fits ``budget`` characters, if it holds ``least`` and
    more than the passage; else ``budget`` characters around the passage inside
    the widest node that is worth reading; with no node that fits, inside the
    narrowest.  Never less than the passage.  Passages without a span are left out.
    """
    width = F.col("node_end") - F.col("node_start")
    fits = width <= budget
    node, depth = F.struct(*_NODE), F.length("path")
    picked = chains(passages, nodes).groupBy("passage_id").agg(
        F.max_by(node, F.when(fits, F.struct(width, -depth))).alias("fit"), F.min_by(node, F.struct(width, -depth)).alias("narrow"), F.max_by(node, F.struct(width, -depth)).alias("wide")
    )
    rows = passages.where("char_start is not null and char_end is not null").join(picked, "passage_id", "left")
    start, end = F.col("char_start"), F.col("char_end")
    span = lambda c: F.col(c)["node_end"] - F.col(c)["node_start"]
    worth = F.greatest(F.lit(least), end - start + 1)
    whole = F.col("fit").isNotNull() & (span("fit") >= worth)
    bound = F.when(whole, F.col("fit")).when(F.col("fit").isNull(), F.col("narrow")).when(span("wide") >= worth, F.col("wide"))
    rows = rows.withColumn("whole", whole).withColumn("b", bound)
    low, high = _centred(start, end, budget, F.col("b"))
    rows = rows.withColumn("window_start", F.least(F.when(F.col("whole"), F.col("b.node_start")).otherwise(low), start)).withColumn("window_end", F.greatest(F.when(F.col("whole"), F.col("b.node_end")).otherwise(high), end))
    same = (F.col("window_start") == start) & (F.col("window_end") == end)
    exact = (F.col("window_start") == F.col("b.node_start")) & (F.col("window_end") == F.col("b.node_end"))
    source = F.when(same, "passage").when(F.col("b").isNull(), "document_window").when(exact, "node").otherwise("node_window")
    return rows.select("passage_id", "doc_id", F.col("window_start").cast("long").alias("window_start"), F.col("window_end").cast("long").alias("window_end"), source.alias("source"), F.col("b.path").alias("bound"))


def read_windows(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """The chosen windows with their ``window`` text, trimmed, its length and estimated tokens; null without a text."""
    cut = F.trim(T.slice_span(F.col("text"), F.col("window_start"), F.col("window_end")))
    read = windows.join(docs.select("doc_id", "text"), "doc_id", "left").withColumn("window", cut).drop("text")
    return read.withColumn("n_chars", F.length("window")).withColumn("tokens", T.approx_tokens(F.col("window")))


def slices(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Every request (request_id, doc_id, start, end) with its ``slice``: null in place where the document has no text."""
    joined = requests.join(docs.select("doc_id", "text"), "doc_id", "left")
    return joined.select("request_id", "doc_id", T.slice_span(F.col("text"), F.col("start"), F.col("end")).alias("slice"))


def anchor_contexts(anchors: DataFrame, docs: DataFrame, nodes: DataFrame, around: int = ANCHOR_CHARS) -> DataFrame:
    """Per anchor (anchor_id, doc_id, start, end): the text around it and the path of the deepest node that holds it."""
    held = spans.deepest_containing(
        anchors.select(F.col("anchor_id").alias("l_id"), "doc_id", F.col("start").alias("l_start"), F.col("end").alias("l_end")),
        nodes.select(F.col("path").alias("r_id"), "doc_id", F.col("node_start").alias("r_start"), F.col("node_end").alias("r_end"), "depth"),
    ).select(F.col("l_id").alias("anchor_id"), F.col("r_id").alias("path"))
    context = T.slice_span(F.col("text"), F.greatest(F.col("start") - around, F.lit(0)), F.col("end") + around)
    # Contexts are many times the text, so they are cut after the last shuffle.
    joined = anchors.join(held, "anchor_id", "left").join(docs.select("doc_id", "text"), "doc_id", "left").withColumn("context", context)
    return joined.select("anchor_id", "doc_id", *[c for c in anchors.columns if c not in ("anchor_id", "doc_id")], "context", "path")


def outline(nodes: DataFrame, max_depth: int | None = None, dated_only: bool = False) -> DataFrame:
    """A document's nodes with ``ord``, their place in tree order (paths compare by component, as text, so n10 is before n2)."""
    rows = nodes if max_depth is None else nodes.where(F.col("depth") <= max_depth)
    rows = rows.where("date_start is not null") if dated_only else rows
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.split("path", r"\."))))


def read_nodes(asked: DataFrame, nodes: DataFrame, docs: DataFrame, descendants: bool = True, max_chars: int = READ_CHARS) -> DataFrame:
    """Prose of each asked node (doc_id, path): its text, or a refusal (``too_long``) rather than a truncation.

    Without descendants the prose stops where the first child begins.
    """
    own = asked.join(nodes, ["doc_id", "path"])
    if not descendants:
        parent = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)
        first = nodes.where(F.instr("path", ".") > 0).select("doc_id", parent.alias("path"), F.col("node_start").alias("child")).groupBy("doc_id", "path").agg(F.min("child").alias("child"))
        own = own.join(first, ["doc_id", "path"], "left").withColumn("node_end", F.coalesce("child", "node_end")).drop("child")
    size = F.col("node_end") - F.col("node_start")
    read = own.join(docs.select("doc_id", "text"), "doc_id", "left")
    return read.select("doc_id", "path", "title", size.alias("n_chars"), (size > max_chars).alias("too_long"), F.when(size <= max_chars, T.slice_span(F.col("text"), F.col("node_start"), F.col("node_end"))).alias("prose"))


def hit_sources(hits: DataFrame, passages: DataFrame, documents: DataFrame, texts: DataFrame) -> DataFrame:
    """Per hit: title, edition, parser version, and whether its document has a text and it has offsets."""
    has = texts.select("doc_id", F.lit(True).alias("has_text"), "parser_version")
    joined = hits.join(passages.select("passage_id", "doc_id", "char_start", "char_end"), "passage_id").join(documents.select("doc_id", "title", "edition"), "doc_id", "left").join(has, "doc_id", "left")
    offsets = F.col("char_start").isNotNull() & F.col("char_end").isNotNull()
    return joined.select("passage_id", "doc_id", "title", "edition", "parser_version", F.coalesce("has_text", F.lit(False)).alias("has_text"), offsets.alias("has_offsets"))


def resolve_location(found: DataFrame, passages: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Per verified quote (quote_id, doc_id, start, end): source text, covering passage ids in order, their locators, the deepest node."""
    asked = found.select(F.col("quote_id").alias("l_id"), "doc_id", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    around = passages.select(F.col("passage_id").alias("r_id"), "doc_id", F.col("char_start").alias("r_start"), F.col("char_end").alias("r_end"))
    met = spans.overlap_join(asked, around).select(F.col("l_id").alias("quote_id"), F.col("r_id").alias("passage_id"), "r_start")
    listed = met.join(passages.select("passage_id", "locator"), "passage_id").groupBy("quote_id").agg(F.sort_array(F.collect_list(F.struct("r_start", "passage_id", "locator"))).alias("c"))
    deep = spans.deepest_containing(asked, nodes.select(F.col("path").alias("r_id"), "doc_id", F.col("node_start").alias("r_start"), F.col("node_end").alias("r_end"), "depth"))
    joined = found.join(listed, "quote_id", "left").join(deep.select(F.col("l_id").alias("quote_id"), F.col("r_id").alias("node")), "quote_id", "left").join(docs.select("doc_id", "text"), "doc_id", "left")
    return joined.select("quote_id", "doc_id", T.slice_span(F.col("text"), F.col("start"), F.col("end")).alias("source_text"), F.col("c.passage_id").alias("passage_ids"), F.array_compact("c.locator").alias("locators"), "node")
