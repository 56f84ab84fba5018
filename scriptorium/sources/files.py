"""File sources: any folder that Spark reads, dispatched by format, parsed in Arrow batches.

A parser is a function of one file's bytes; parsed rows carry the sections that
its format declares, with offsets into the parsed text.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARSED = "path string, format string, title string, text string, language string, sections array<struct<char_start int, char_end int, heading string, level int>>, metadata map<string,string>, error string"
#: Formats by file ending.
FORMATS = {"txt": "text", "text": "text", "md": "markdown", "markdown": "markdown", "mdown": "markdown", "mkd": "markdown", "html": "html", "htm": "html", "xhtml": "html", "xml": "tei", "tei": "tei", "epub": "epub"}
TITLE_CHARS, HEAD_BYTES = 200, 4096


class Parsed(dict):
    """title, text, language, sections and metadata (of which empty values are left out) of one file."""

    def __init__(self, title: str = "", text: str = "", language: str | None = None, sections: list[dict] | None = None, **metadata: object):
        kept = {k: str(v) for k, v in metadata.items() if v not in (None, "")}
        super().__init__(title=title, text=text, language=language, sections=sections or [], metadata=kept | {"char_count": str(len(text))})


def _first_line(text: str) -> str:
    """The first line with words that is short enough for a title."""
    return next((line.strip() for line in text.splitlines() if 0 < len(line.strip()) <= TITLE_CHARS), "")


def parse_text(data: bytes, name: str) -> Parsed:
    text = data.decode("utf-8", "replace")
    return Parsed(_first_line(text) or name, text, line_count=len(text.splitlines()))


#: What is taken off a markdown text, in this order, and what stays of it. Headings keep their marks.
_MARKDOWN = [(re.compile(a, re.M), b) for a, b in (
    (r"```[\s\S]*?```", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", r"\1"),
    (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
    (r"(\*{1,3}|_{1,3})(.+?)\1", r"\2"),
    (r"~~(.+?)~~", r"\1"),
    (r"`([^`]+)`", r"\1"),
    (r"<[^>]+>", ""),
    (r"^>\s?", ""),
    (r"^[-*_]{3,}\s*$", ""),
    (r"^(\s*)[-*+]\s+", r"\1"),
    (r"^(\s*)\d+\.\s+", r"\1"),
    (r"\n{3,}", "\n\n"),
)]


def parse_markdown(data: bytes, name: str) -> Parsed:
    """Formatting stripped, headings kept; each heading opens a section up to the next. The title is the file's first heading."""
    raw = text = data.decode("utf-8", "replace")
    for pattern, to in _MARKDOWN:
        text = pattern.sub(to, text)
    text = text.strip()
    heads = list(re.finditer(r"(?m)^(#{1,6})[ \t]+(\S.*?)[ \t]*$", text))
    ends = [h.start() for h in heads[1:]] + [len(text)]
    sections = [{"char_start": h.start(), "char_end": h.start() + len(text[h.start() : e].rstrip()), "heading": h[2].strip(), "level": len(h[1])} for h, e in zip(heads, ends, strict=False)]
    title = re.search(r"(?m)^#{1,6}\s+(.+)$", raw)
    return Parsed(title[1].strip() if title else name, text, None, sections, heading_count=len(sections))


class _Html(HTMLParser):
    """The stripped pieces of text in order, whether each stands in the title and in the body, and the headings by the piece that they open with."""

    SILENT = ("script", "style", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[tuple[str, bool, bool]] = []
        self.heads: list[dict] = []
        self.open: list[dict] = []
        self.meta: dict[str, str] = {}
        self.silent = self.links = 0
        self.in_title = self.in_body = self.has_body = False

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "html":
            self.meta.setdefault("lang", own.get("lang", ""))
        elif tag == "meta":
            self.meta[(own.get("name") or own.get("property") or "").lower()] = own.get("content", "")
        elif tag == "title":
            self.in_title = True
        elif tag == "body":
            self.in_body = self.has_body = True
        elif tag == "a":
            self.links += "href" in own
        elif re.fullmatch("h[1-6]", tag):
            head = {"at": len(self.pieces), "words": [], "level": int(tag[1]), "body": self.in_body}
            self.heads.append(head)
            self.open.append(head)

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "body":
            self.in_body = False
        elif any(f"h{h['level']}" == tag for h in self.open):
            while f"h{self.open.pop()['level']}" != tag:
                pass

    def handle_data(self, data):
        piece = data.strip()
        if piece and not self.silent:
            self.pieces.append((piece, self.in_title, self.in_body))
            for head in self.open:
                head["words"].append(piece)


def _read_html(data: bytes) -> _Html:
    parser = _Html()
    parser.feed(data.decode("utf-8", "replace"))
    parser.close()
    return parser


def parse_html(data: bytes, name: str) -> Parsed:
    """HTML: the body's pieces of text, one a line; a heading opens a section up to the next; title from title, else h1, else the file's name."""
    page = _read_html(data)
    chosen = [i for i, (_, _, in_body) in enumerate(page.pieces) if in_body or not page.has_body]
    starts, at = {}, 0
    for i in chosen:
        starts[i] = at
        at += len(page.pieces[i][0]) + 1
    text = "\n".join(page.pieces[i][0] for i in chosen)
    opens = [(next((starts[i] for i in chosen if i >= h["at"]), len(text)), h) for h in page.heads if h["body"] or not page.has_body]
    ends = [start for start, _ in opens[1:]] + [len(text)]
    sections = [{"char_start": a, "char_end": a + len(text[a:b].rstrip()), "heading": " ".join(h["words"]), "level": h["level"]} for (a, h), b in zip(opens, ends, strict=False) if text[a:b].strip()]
    title = "".join(piece for piece, in_title, _ in page.pieces if in_title) or next(("".join(h["words"]) for h in page.heads if h["level"] == 1), "")
    language = page.meta.get("language") or page.meta.get("lang") or None
    return Parsed(title or name, text, language, sections, heading_count=len(page.heads), link_count=page.links, description=page.meta.get("description"), author=page.meta.get("author"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse_tei(data: bytes, name: str) -> Parsed:
    """TEI: title from the header, one section per body div, its own prose only: heads, children, and the text between them.

    Inline pieces (list items, lines) are joined by a space, so that none are welded.
    """
    root = ElementTree.fromstring(data)
    find = lambda node, tag: next((x for x in node.iter() if _local(x.tag) == tag), None)
    clean = lambda text: re.sub(r"\s+", " ", text or "").strip()
    header, body = find(root, "teiHeader"), find(root, "body")
    title = find(header, "title") if header is not None else None
    pieces: list[str] = []
    sections: list[dict] = []
    size = 0

    def add(text: str) -> bool:
        nonlocal size
        if text:
            pieces.append(text)
            size += len(text) + 1
        return bool(text)

    def walk(node, level: int) -> None:
        start, head, own = size, None, add(clean(node.text))

        def close() -> None:
            if level and (own or head):
                sections.append({"char_start": start, "char_end": max(start, size - 1), "heading": head or "", "level": level})

        for child in node:
            if _local(child.tag).startswith("div"):
                close()
                walk(child, level + 1)
                start, own, head = size, False, None
            else:
                piece = clean(" ".join(filter(None, map(clean, child.itertext()))))
                head = piece if _local(child.tag) == "head" else head
                own = add(piece) or own
            own = add(clean(child.tail)) or own
        close()

    if body is not None:
        walk(body, 0)
    language = root.get("{http://www.w3.org/XML/1998/namespace}lang")
    return Parsed(clean("".join(title.itertext())) if title is not None else name, "\n".join(pieces), language, sections)


def _contents(book: zipfile.ZipFile, base: str, items: dict) -> dict[str, tuple[str, int]]:
    """Title and depth of the files that a book's table of contents (NCX, else the navigation document) names; the shallowest entry of a file wins."""
    found: dict[str, tuple[str, int]] = {}
    links: list[tuple[str, str, int]] = []

    def walk(node, entry: str, depth: int, read: Callable) -> None:
        for child in node:
            below = depth + (_local(child.tag) == entry)
            if below > depth and (link := read(child)):
                links.append((*link, below))
            walk(child, entry, below, read)

    def point(node):
        label = next((x for x in node if _local(x.tag) == "navLabel"), None)
        content = next((x for x in node if _local(x.tag) == "content"), None)
        return None if label is None or content is None else (content.get("src") or "", " ".join("".join(label.itertext()).split()))

    def anchor(node):
        link = next((x for x in node if _local(x.tag) == "a"), None)
        return None if link is None else (link.get("href") or "", " ".join("".join(link.itertext()).split()))

    ncx = next((x for x in items.values() if x.get("media-type") == "application/x-dtbncx+xml"), None)
    nav = next((x for x in items.values() if "nav" in (x.get("properties") or "").split()), None)
    for item, entry, read in ((ncx, "navPoint", point), (nav, "li", anchor)):
        if item is None or links:
            continue
        file = posixpath.join(base, item.get("href"))
        try:
            walk(ElementTree.fromstring(book.read(file)), entry, 0, read)
        except (ElementTree.ParseError, KeyError):
            continue  # without a readable table of contents the chapters' own headings name them
        links = [(posixpath.normpath(posixpath.join(posixpath.dirname(file), href.partition("#")[0])), title, depth) for href, title, depth in links if href.partition("#")[0] and title]
    for target, title, depth in links:
        if target not in found or depth < found[target][1]:
            found[target] = (title, depth)
    return found


def parse_epub(data: bytes, name: str) -> Parsed:
    """EPUB: files in spine order, without the navigation document; each is a section, named by the table of contents, else by its most important heading."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile")
        opf = ElementTree.fromstring(book.read(package))
        base = posixpath.dirname(package)
        items = {x.get("id"): x for x in opf.iter() if _local(x.tag) == "item"}
        meta: dict[str, str] = {}
        for x in (x for part in opf if _local(part.tag) == "metadata" for x in part):
            meta.setdefault(_local(x.tag), (x.text or "").strip())
        contents = _contents(book, base, items)
        text, sections = "", []
        for ref in (x for x in opf.iter() if _local(x.tag) == "itemref"):
            item = items.get(ref.get("idref"))
            if item is None or "nav" in (item.get("properties") or "").split():
                continue
            file = posixpath.normpath(posixpath.join(base, item.get("href")))
            page = _read_html(book.read(file))
            chapter = "\n".join(piece for piece, _, _ in page.pieces)
            if not chapter:
                continue
            start = len(text) + 2 if text else 0
            text = f"{text}\n\n{chapter}" if text else chapter
            named = sorted((h["level"], i, "".join(h["words"])) for i, h in enumerate(page.heads) if h["words"])
            heading, level = contents.get(file) or ((named[0][2], named[0][0]) if named else ("", 0))
            sections.append({"char_start": start, "char_end": len(text), "heading": heading, "level": level})
    more = {f"dc_{k}": meta.get(k) for k in ("publisher", "date", "description", "identifier")}
    return Parsed(meta.get("title") or name, text, meta.get("language") or None, sections, chapter_count=len(sections), author=meta.get("author") or meta.get("creator"), **more)


PARSERS: dict[str, Callable[[bytes, str], Parsed]] = {"text": parse_text, "markdown": parse_markdown, "html": parse_html, "tei": parse_tei, "epub": parse_epub}


def register(format_name: str, endings: list[str], parser: Callable[[bytes, str], Parsed]) -> None:
    """Add a format; a name or an ending that is taken is an error."""
    taken = [e for e in endings if e in FORMATS] + ([format_name] if format_name in PARSERS else [])
    if taken:
        raise ValueError(f"already registered: {taken}")
    PARSERS[format_name] = parser
    FORMATS.update(dict.fromkeys(endings, format_name))


def detected(name: Column, head: Column) -> Column:
    """A file's format by its ending, else by the beginning of its content: HTML, TEI and markdown by their marks, archives, and what else is text."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    # The last character may be cut.
    text = F.regexp_replace(F.make_valid_utf8(F.substring(head, 1, HEAD_BYTES).cast("string")), "\ufffd{1,3}$", "")
    return F.coalesce(
        F.try_element_at(table, F.lower(F.element_at(F.split(name, r"\."), -1))),
        F.when(F.hex(F.substring(head, 1, 4)) == "504B0304", "epub"),
        F.when(F.contains(F.lower(text), F.lit("<html")) | F.contains(F.lower(text), F.lit("<!doctype html")), "html"),
        F.when(F.regexp_like(text, F.lit(r"<TEI[\s>]")), "tei"),
        F.when(F.regexp_like(text, F.lit(r"(?m)^#{1,6}\s+")), "markdown"),
        F.when(~F.contains(text, F.lit("\u0000")) & ~F.contains(text, F.lit("\ufffd")), "text"),
    )


def scan(spark: SparkSession, folder: str, forbidden: list[str] | None = None) -> DataFrame:
    """Files under a folder with their format: path, format, content.  Hidden files, those in hidden folders and those under ``forbidden`` folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    below = F.regexp_replace("path", f"^.*?{re.escape(folder.rstrip('/').rpartition('/')[2])}(?=/)", "")
    kept = files.where(~F.regexp_like(below, F.lit(r"/\.")))
    for root in forbidden or []:
        kept = kept.where(~F.contains("path", F.lit(f"{root.rstrip('/')}/")))
    return kept.select("path", detected(name, F.col("content")).alias("format"), "content")


def parse(files: DataFrame, hint: str | None = None) -> DataFrame:
    """Documents of ``files(path, format, content)``; a file that can't be parsed is a row with an error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, kind, data in zip(pdf["path"], pdf["format"], pdf["content"], strict=True):
                kind = hint or kind
                try:
                    if kind not in PARSERS:
                        raise ValueError(f"no parser for format {kind!r}")
                    parsed = PARSERS[kind](data, posixpath.splitext(posixpath.basename(path))[0])
                    rows.append((path, kind, parsed["title"], parsed["text"], parsed["language"], parsed["sections"], parsed["metadata"], None))
                except Exception as e:  # one bad file must not end the job
                    rows.append((path, kind, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "format", "title", "text", "language", "sections", "metadata", "error"])

    return files.mapInPandas(run, PARSED)


def ingest(spark: SparkSession, folder: str, store: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """New documents of a folder: parsed, hashed, none whose (content_hash, source) the store holds."""
    parsed = parse(scan(spark, folder), hint).where("error is null")
    hashed = parsed.withColumn("content_hash", F.sha2("text", 256)).withColumn("source", F.col("path"))
    fresh = hashed.dropDuplicates(["content_hash", "source"])
    return fresh if store is None else fresh.join(store, ["content_hash", "source"], "left_anti")
