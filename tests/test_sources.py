"""Parsers of files: metadata, contents tables, detection by content."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.sources import files


def test_html_metadata_sections_and_bodies():
    page = b"""<html lang="de"><head><title> A  title </title><meta name="Description" content="about"><meta property="author" content="N. N."></head>
    <body>before<h1>One <i>two</i></h1><p>x &amp; y<!-- no --></p><noscript>no</noscript><h2></h2><h3>Three</h3><a href="u">link</a><a>none</a></body></html>"""
    got = files.parse_html(page, "name")
    assert (got["title"], got["language"], got["text"]) == ("A  title", "de", "before\nOne\ntwo\nx & y\nThree\nlink\nnone")
    assert [(got["text"][s["char_start"] : s["char_end"]], s["heading"], s["level"]) for s in got["sections"]] == [("One\ntwo\nx & y", "One two", 1), ("Three\nlink\nnone", "Three", 3)]
    assert got["metadata"] == {"heading_count": "3", "link_count": "1", "description": "about", "author": "N. N.", "char_count": str(len(got["text"]))}
    bare = files.parse_html(b"<title>T</title><p>no body", "name")
    assert bare["text"] == "T\nno body" and files.parse_html(b"<body><p>x</p>", "name")["title"] == "name"
    assert files.parse_html(b'<meta name="language" content="fr"><html lang="de"><h2>x</h2><h1>y</h1>', "n")["language"] == "fr"


def test_markdown():
    raw = b"intro\n# A **bold** [head](u)\n\n\n\n> quote\n\n- item\n1. first\n```\n# code\n```\n---\n~~old~~ ![pic](u) `c` <b>t</b> ***both***\n## Next ##\ntext"
    got = files.parse_markdown(raw, "name")
    assert got["title"] == "A **bold** [head](u)" and got["text"].startswith("intro\n# A bold head\n\nquote\n\nitem\nfirst\n") and "code" not in got["text"]
    assert "old pic c t both" in got["text"] and [(s["heading"], s["level"]) for s in got["sections"]] == [("A bold head", 1), ("Next ##", 2)]
    assert all(got["text"][s["char_start"] : s["char_end"]] == got["text"][s["char_start"] : s["char_end"]].strip() for s in got["sections"])
    assert files.parse_markdown(b"no heading", "name")["title"] == "name" and files.parse_text(b"\n" + b"x" * 201 + b"\nshort\n", "name")["title"] == "short"


def book(contents: dict[str, str], extra: str = "", manifest: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='o/p.opf'/></rootfiles></container>")
        items = "".join(f"<item id='i{n}' href='{name}'/>" for n, name in enumerate(contents))
        refs = "".join(f"<itemref idref='i{n}'/>" for n in reversed(range(len(contents))))
        z.writestr("o/p.opf", f"<package xmlns:dc='d'><metadata><dc:title>B</dc:title><dc:language>en</dc:language><dc:creator>C</dc:creator><dc:publisher>P</dc:publisher>{extra}</metadata><manifest>{items}{manifest}</manifest><spine>{refs}</spine></package>")
        for name, text in contents.items():
            z.writestr(f"o/{name}", text)
        z.writestr("o/toc.ncx", "<ncx><navMap><navPoint><navLabel><text>Part</text></navLabel><content src='t/a.html#x'/><navPoint><navLabel><text>Deep</text></navLabel><content src='b.html'/></navPoint></navPoint><navPoint><navLabel><text>Bee</text></navLabel><content src='b.html#y'/></navPoint></navMap></ncx>")
        z.writestr("o/nav/n.html", "<html><body><nav><ol><li><a href='../t/a.html'>Nav A</a><ol><li><a href='../b.html'>Nav B</a></li></ol></li></ol></nav></body></html>")
        z.writestr("o/broken.ncx", "<ncx>")
    return out.getvalue()


def test_epub_contents_tables():
    chapters = {"t/a.html": "<html><head><title>T</title></head><body><h2>Own</h2>text a</body></html>", "b.html": "<h3>Low</h3><h1>High</h1>text b", "c.html": "<p>plain</p>", "d.html": "<p> </p>"}
    sections = lambda *a: [(s["heading"], s["level"]) for s in files.parse_epub(book(chapters, *a), "n")["sections"]]
    ncx, nav, broken = "<item id='ncx' href='toc.ncx' media-type='application/x-dtbncx+xml'/>", "<item id='nav' href='nav/n.html' properties='nav'/>", "<item id='ncx' href='broken.ncx' media-type='application/x-dtbncx+xml'/>"
    assert sections("", ncx) == [("", 0), ("Bee", 1), ("Part", 1)]
    assert sections("", nav) == [("", 0), ("Nav B", 2), ("Nav A", 1)] == sections("", broken + nav)
    assert sections() == [("", 0), ("High", 1), ("Own", 2)] == sections("", broken)
    got = files.parse_epub(book(chapters, "<dc:date>1862</dc:date>"), "n")
    assert got["text"] == "plain\n\nLow\nHigh\ntext b\n\nT\nOwn\ntext a" and all(got["text"][s["char_start"] : s["char_end"]].strip() for s in got["sections"])
    assert got["metadata"] == {"chapter_count": "3", "author": "C", "dc_publisher": "P", "dc_date": "1862", "char_count": str(len(got["text"]))} and got["language"] == "en"


def test_detection_and_scan(spark, tmp_path):
    named = {
        "a.MD": (b"x", "markdown"), "page": (b"<!DOCTYPE HTML><p>x", "html"), "xml.dat": (b"<?xml?><TEI xmlns='t'/>", "tei"), "notes": (b"text\n## Head", "markdown"), "plain.log": ("é".encode() * 4095, "text"), "book.bin": (book({"a.html": "x"}), "epub"),
        "binary": (bytes(range(256)) * 20, None),
    }
    for name, (data, _) in named.items():
        (tmp_path / name).write_bytes(data)
    for name in (".git/x.txt", "private/y.txt"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text("z")
    got = {r.path.rsplit("/", 1)[-1]: r.format for r in files.scan(spark, str(tmp_path), [str(tmp_path / "private")]).collect()}
    assert got == {name: kind for name, (_, kind) in named.items()}
    parsed = {r.path.rsplit("/", 1)[-1]: r for r in files.parse(files.scan(spark, str(tmp_path))).collect()}
    assert parsed["binary"].error and parsed["page"].metadata["link_count"] == "0" and parsed["book.bin"].title == "B"


@pytest.mark.parametrize(("raw", "title", "author"), [
    ("Letter_ John", "Letter_ John", "Letter_ John"), ("output_CSantiago_x", None, None), ("Document 12", None, "Document 12"), ("Microsoft Word - PFS.doc", None, "Microsoft Word - PFS.doc"), ("A Report.docx", "A Report", "A Report.docx"),
    ("749537 NCM9JP01", None, None), ("1099", None, None), ("PWinter", "PWinter", None), ("McClellan", "McClellan", "McClellan"), ("(none)", "(none)", None), ("  ", None, None), (None, None, None), ("ends_", None, None), ("Ünïcödé", "Ünïcödé", "Ünïcödé"),
])
def test_usable_names(spark, raw, title, author):
    row = spark.createDataFrame([(raw,)], "x string").select(T.usable_title(F.col("x")).alias("t"), T.usable_author(F.col("x")).alias("a")).first()
    assert (row.t, row.a) == (title, author)
