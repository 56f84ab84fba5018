"""Chunkers: documents to passages whose text is exactly the canonical slice.

Each chunker is a small function of one text; Spark deals documents to Arrow
batches and explodes the spans.  Spans are half-open code points.  Sizes are in
tokens, estimated by script, so that a window holds as much in Greek or Chinese
as in English; pure ASCII texts count four characters a token.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from scriptorium.functions import text as T
from scriptorium.functions import tokens as K

Span = tuple[int, int]
#: Sizes in tokens or characters that chunkers must share with the stored passages.
FIXED_CHARS, FIXED_OVERLAP = 2000, 200
PROSE_TOKENS, PROSE_OVERLAP = 500, 50
WHOLE_TOKENS, CEILING_TOKENS = 600, 2000
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_BLANK = re.compile(r"\n\s*\n")
_HEADING = re.compile(r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")


def trim(text: str, span: Span) -> Span | None:
    """The span without white space at its ends; None if nothing is left."""
    start, end = span
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return (start, end) if start < end else None


def between(text: str, breaks: re.Pattern) -> list[Span]:
    """Trimmed spans between the matches of a pattern."""
    edges, out, at = [(m.start(), m.end()) for m in breaks.finditer(text)] + [(len(text), len(text))], [], 0
    for start, end in edges:
        if span := trim(text, (at, start)):
            out.append(span)
        at = end
    return out


def split_long(text: str, span: Span, most: int) -> list[Span]:
    """A span in pieces of at most ``most`` characters, each up to the last newline in reach, else space, else full; blank ones are left out."""
    start, end = span
    out = []
    while end - start > most:
        reach = (start + 1, start + most)
        at = next((x for x in (text.rfind("\n", *reach), text.rfind(" ", *reach)) if x > start), reach[1])
        out.append((start, at))
        start = at
    return [(a, b) for a, b in [*out, (start, end)] if text[a:b].strip()]


def capped(text: str, spans: list[Span], most: int) -> list[Span]:
    """Spans of more than ``most`` tokens by their own script mix, split at their densest script."""
    out = []
    for a, b in spans:
        own = text[a:b]
        fits = K.count(len(own), K.rate(own)) <= most
        out += [(a, b)] if fits else split_long(text, (a, b), K.budget(most, K.densest(own)))
    return out


def fixed_window(text: str, size: int = FIXED_CHARS, overlap: int = FIXED_OVERLAP) -> list[Span]:
    """Trimmed windows of ``size`` characters (of ASCII; fewer in a denser script), each beginning ``overlap`` before the end of the last."""
    scale = K.rate(text) / K.ASCII
    size, overlap = max(1, int(size * scale)), int(overlap * scale)
    step, out = max(1, size - overlap), []
    for start in range(0, max(len(text), 1), step):
        if span := trim(text, (start, min(start + size, len(text)))):
            out.append(span)
        if start + size >= len(text):
            break
    return out


def paragraphs(text: str) -> list[Span]:
    return between(text, _BLANK)


def sentences(text: str) -> list[Span]:
    """Spans between sentence ends; the white space there is in none."""
    ends = [(0, 0), *(m.span() for m in _SENTENCE.finditer(text)), (len(text), len(text))]
    return [(a[1], b[0]) for a, b in zip(ends, ends[1:], strict=False) if a[1] < b[0]]


def prose_window(text: str, budget: int = PROSE_TOKENS, overlap: int = PROSE_OVERLAP) -> list[Span]:
    """Whole sentences up to ``budget`` tokens; a window repeats the last sentences that fit ``overlap`` tokens."""
    if not text.strip():
        return []
    rate = K.rate(text)
    size = lambda span: K.count(span[1] - span[0], rate)
    units = capped(text, [p for s in sentences(text) for p in split_long(text, s, K.budget(budget, rate))], budget)
    out: list[Span] = []
    window: list[Span] = []
    held = 0
    for unit in units:
        if window and held + size(unit) > budget:
            out.append((window[0][0], window[-1][1]))
            kept, held = len(window), 0
            while kept and held + size(window[kept - 1]) <= overlap:
                kept -= 1
                held += size(window[kept])
            window = window[kept:]
        window.append(unit)
        held += size(unit)
    return [*out, (window[0][0], window[-1][1])] if window else out


def whole_or_paragraph(text: str) -> list[Span]:
    """The whole text if short, else its paragraphs, none above the ceiling."""
    if not text.strip():
        return []
    short = K.count(len(text), K.rate(text)) <= WHOLE_TOKENS and len(text) <= K.budget(CEILING_TOKENS, K.densest(text))
    return [(0, len(text))] if short else paragraph_passages(text)


def paragraph_passages(text: str) -> list[Span]:
    """Paragraphs, none above the ceiling, which is that of the text's densest script."""
    most = K.budget(CEILING_TOKENS, K.densest(text))
    return [p for s in paragraphs(text) for p in split_long(text, s, most)]


def markdown_sections(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, heading, level) of each heading's own prose, up to the next heading."""
    heads = list(_HEADING.finditer(text))
    return [(h.start(), n.start() if n else len(text), h[2], len(h[1])) for h, n in zip(heads, [*heads[1:], None], strict=False)]


def structural(text: str) -> list[Span]:
    """A section is a passage if it fits a prose window by its own scripts, else prose windows; text before the first heading is one too. Without sections, prose windows."""
    sections = markdown_sections(text)
    if not sections:
        return prose_window(text)
    lead = [(0, sections[0][0], "", 0)] if sections[0][0] else []
    out = []
    for start, end, _, _ in lead + sections:
        span = trim(text, (start, end))
        own = text[slice(*span)] if span else ""
        if own and K.count(len(own), K.rate(own)) <= PROSE_TOKENS:
            out.append(span)
        elif own:
            out += [(span[0] + a, span[0] + b) for a, b in prose_window(own)]
    return out


CHUNKERS: dict[str, Callable[[str], list[Span]]] = {
    "fixed_window": fixed_window, "paragraph": paragraph_passages, "prose_window": prose_window, "whole_or_paragraph": whole_or_paragraph, "structural": structural,
}


def chunk(docs: DataFrame, chunker: str | Callable[[str], list[Span]]) -> DataFrame:
    """Passages of each document: doc_id, position, char_start, char_end, text, tokens (estimated at the passage's own rate by ``structural``, else at the document's)."""
    cut = CHUNKERS[chunker] if isinstance(chunker, str) else chunker
    own_rate = cut is structural

    @F.pandas_udf("array<struct<char_start int, char_end int, tokens int>>")
    def spans(texts: pd.Series) -> pd.Series:
        def of(text: str) -> list[dict]:
            rate = K.rate(text)
            return [{"char_start": a, "char_end": b, "tokens": K.count(b - a, K.rate(text[a:b]) if own_rate else rate)} for a, b in cut(text)]

        return texts.map(lambda t: of(t or ""))

    exploded = docs.select("doc_id", "text", F.posexplode(spans("text")).alias("position", "s"))
    slice_ = F.substring("text", F.col("s.char_start") + 1, F.col("s.char_end") - F.col("s.char_start"))
    return exploded.select("doc_id", "position", "s.char_start", "s.char_end", slice_.alias("text"), "s.tokens")


def fixed_windows_native(docs: DataFrame, size: int = FIXED_CHARS, overlap: int = FIXED_OVERLAP) -> DataFrame:
    """Untrimmed fixed windows without Python, in one pass over each text: doc_id, position, char_start, char_end, text."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - size) / step), F.lit(0)).cast("int")
    at = docs.where("length(text) > 0").select("doc_id", F.posexplode(F.slice(T.windows(F.col("text"), size, step), 1, last + 1)).alias("position", "text"))
    start = F.col("position") * step
    return at.select("doc_id", "position", start.alias("char_start"), (start + F.length("text")).alias("char_end"), "text")


def paragraphs_native(docs: DataFrame) -> DataFrame:
    """Lines of each document with running offsets, without Python: doc_id, position, char_start, n_chars, text.

    Offsets are a running sum, so work is linear in a document's lines; line
    texts are shuffled only if the caller reads them.
    """
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("position", "text"))
    measured = lines.select("doc_id", "position", F.length("text").alias("n_chars"), (F.trim("text") == "").alias("blank"), "text")
    before = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n_chars") + 1).over(before), F.lit(0)).alias("char_start")
    return measured.select("doc_id", "position", start, "n_chars", "text", "blank").where("not blank").drop("blank")


_NODE = Ty.StructType([Ty.StructField("path", Ty.StringType()), Ty.StructField("depth", Ty.IntegerType()), Ty.StructField("heading", Ty.StringType()), Ty.StructField("char_start", Ty.IntegerType()), Ty.StructField("char_end", Ty.IntegerType())])


@F.pandas_udf(Ty.ArrayType(_NODE))
def node_tree(texts: pd.Series) -> pd.Series:
    """Nodes of a text's markdown headings: a level stack gives paths; a parent's span covers its descendants."""

    def tree(text: str | None) -> list[dict]:
        text = text or ""
        nodes = [{"path": "r", "depth": 0, "heading": "", "char_start": 0, "char_end": len(text)}]
        stack: list[tuple[int, dict]] = [(0, nodes[0])]
        children: dict[str, int] = {}
        for start, end, heading, level in markdown_sections(text):
            while stack[-1][0] >= level:
                stack.pop()
            parent = stack[-1][1]
            n = children.get(parent["path"], 0)
            children[parent["path"]] = n + 1
            node = {"path": f"{parent['path']}.n{n}", "depth": parent["depth"] + 1, "heading": heading, "char_start": start, "char_end": end}
            for _, up in stack:
                up["char_end"] = max(up["char_end"], end)
            nodes.append(node)
            stack.append((level, node))
        return nodes

    return texts.map(tree)
