"""Text scalars: folding, locating, slicing, identifiers, token estimates.

Offsets are half-open code points everywhere.  Columns stay JVM-side; only
NFKC, which Spark lacks, runs in Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: Quotation marks and dashes that folding maps to ASCII.
QUOTES_SINGLE = "‘’‚‛′ʼ"
QUOTES_DOUBLE = "“”„‟″«»"
DASHES = "‐‑‒–—―−"
SOFT_HYPHEN = "­"


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def ascii_marks(text: Column) -> Column:
    """Typographic quotes and dashes as ASCII, soft hyphens dropped."""
    text = F.replace(text, F.lit(SOFT_HYPHEN), F.lit(""))
    source = QUOTES_SINGLE + QUOTES_DOUBLE + DASHES
    target = "'" * len(QUOTES_SINGLE) + '"' * len(QUOTES_DOUBLE) + "-" * len(DASHES)
    return F.translate(text, source, target)


def join_hyphens(text: Column) -> Column:
    """A word broken by a hyphen at a line's end is one word (only before a lower-case letter)."""
    return F.regexp_replace(text, r"(?U)(\p{L})-[ \t]*\r?\n[ \t]*(\p{Ll})", "$1$2")


@F.pandas_udf(Ty.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold_simple(text: Column) -> Column:
    """The JVM part of :func:`fold`: for text already in NFKC."""
    return collapse_space(ascii_marks(F.lower(join_hyphens(F.replace(text, F.lit(SOFT_HYPHEN), F.lit(""))))))


def fold(text: Column) -> Column:
    """Canonical matching form: NFKC, soft hyphens, line-end hyphens, case, marks, white space.

    ASCII texts, which NFKC leaves as they are, don't leave the JVM.
    """
    other = F.when(F.octet_length(text) != F.length(text), text)
    return fold_simple(F.coalesce(nfkc(other), text))


FOLD_MAP = Ty.StructType([Ty.StructField("text", Ty.StringType()), Ty.StructField("starts", Ty.ArrayType(Ty.IntegerType()))])


class _Folded(dict):
    """What :func:`fold_with_offsets` writes for a character, for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        marked = ("'" if x in QUOTES_SINGLE else '"' if x in QUOTES_DOUBLE else "-" if x in DASHES else x for x in unicodedata.normalize("NFKC", c).lower())
        self[code] = "" if c == SOFT_HYPHEN else "".join(" " if x.isspace() else x for x in marked)
        return self[code]


_FOLDED, _BROKEN, _SPACES = _Folded(), re.compile(r"-[ \t]*(?:\r\n?|\n)[ \t]*"), re.compile(" {2,}")


def _joined(m: re.Match) -> str:
    text, start, end = m.string, m.start(), m.end()
    return "" if start and text[start - 1].isalpha() and end < len(text) and text[end].islower() else m[0]


def folded_text(text: str) -> str:
    """The text of :func:`fold_with_offsets` without its offsets, in a few passes instead of a step a character."""
    return _SPACES.sub(" ", _BROKEN.sub(_joined, text).translate(_FOLDED)).strip(" ")


def fold_with_offsets(text: str, upto: int | None = None) -> tuple[str, list[int]]:
    """Fold character by character; ``starts[i]`` is the raw offset behind folded character i.

    With ``upto`` it ends as soon as that many folded characters are there.
    """
    out: list[str] = []
    starts: list[int] = []
    n, i = len(text), 0
    while i < n:
        if upto is not None and len(out) >= upto:
            return "".join(out), starts
        c = text[i]
        if c == SOFT_HYPHEN:
            i += 1
            continue
        if c == "-" and i and text[i - 1].isalpha():
            j = i + 1
            while j < n and text[j] in " \t":
                j += 1
            if j < n and text[j] in "\r\n":
                j += 2 if text[j : j + 2] == "\r\n" else 1
                while j < n and text[j] in " \t":
                    j += 1
                if j < n and text[j].islower():
                    i = j
                    continue
        for x in unicodedata.normalize("NFKC", c).lower():
            x = "'" if x in QUOTES_SINGLE else '"' if x in QUOTES_DOUBLE else "-" if x in DASHES else x
            if x.isspace():
                if not out or out[-1] == " ":
                    continue
                x = " "
            out.append(x)
            starts.append(i)
        i += 1
    while out and out[-1] == " ":
        out.pop()
        starts.pop()
    return "".join(out), starts


@F.pandas_udf(FOLD_MAP)
def fold_map(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else fold_with_offsets(t) for t in texts]
    return pd.DataFrame(rows, columns=["text", "starts"])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` worked out once a row however often ``body`` names it (lambdas and branches would repeat it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def locate0(text: Column, needle: Column) -> Column:
    """0-based offset of ``needle``, null if absent."""
    at = F.instr(text, needle)
    return F.when(at > 0, at - 1)


def slice_span(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]``, clamped to the text."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, (low + 1).cast("int"), F.greatest(end - low, F.lit(0)).cast("int"))


def windows(text: Column, size: int, step: int | None = None) -> Column:
    """The windows of ``size`` characters that begin every ``step`` (``size`` if None) characters of a text, the last ones shorter; none for an empty text.

    One pass over the text; slices by offset would each count its characters from the start.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step or size}}}"), F.lit(1))


def words(text: Column) -> Column:
    """Lower-case words (letters and digits of any script), in order."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two leading spaces and a trailing one."""
    # A line a word; the trigrams are cut in one pass, as lambdas over words and offsets cost many times as much.
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}]+", " \n  "), F.lit(" "))
    return F.array_remove(F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?=([^\n]{3}))[^\n]"), F.lit(1))), "   ")


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two column of trigram arrays (0 if neither has any)."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def approx_tokens(text: Column) -> Column:
    """Token estimate: length over characters per token (4 for ASCII, fewer the more bytes a character takes)."""
    rate = F.greatest(F.lit(1.0), 4.0 * F.length(text) / F.greatest(F.octet_length(text), F.lit(1)))
    return F.greatest(F.lit(1), F.floor(F.length(text) / rate).cast("int"))


def first_doi(text: Column) -> Column:
    """First DOI in a text, lower-case, without closing punctuation; empty if there is none."""
    found = F.lower(F.regexp_extract(text, r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)", 1))
    return F.regexp_replace(found, r"[.,;:)\]}'\"]+$", "")


def isbn13(text: Column) -> Column:
    """A valid ISBN-10 or ISBN-13 as 13 digits; null otherwise."""
    return bound(F.upper(F.regexp_replace(text, r"[\s-]", "")), _valid_isbn)


def _valid_isbn(bare: Column) -> Column:
    digit = lambda s, i: F.when(F.substring(s, i, F.lit(1)) == "X", F.lit(10)).otherwise(F.expr("0") + F.substring(s, i, F.lit(1)).try_cast("int"))

    def total(s: Column, n: int, weight) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda acc, i: acc + F.coalesce(digit(s, i), F.lit(0)) * weight(i))

    alternating = lambda i: F.when(i % 2 == 1, F.lit(1)).otherwise(F.lit(3))
    stem = F.concat(F.lit("978"), F.substring(bare, 1, 9))
    check = F.pmod(F.lit(10) - total(stem, 12, alternating) % 10, F.lit(10)).cast("string")
    long_ok = bare.rlike(r"^\d{13}$") & (total(bare, 13, alternating) % 10 == 0)
    short_ok = bare.rlike(r"^\d{9}[\dX]$") & (total(bare, 10, lambda i: F.lit(11) - i) % 11 == 0)
    return F.when(long_ok, bare).when(short_ok, F.concat(stem, check))


def year(text: Column) -> Column:
    """Leading four-digit year, null if there is none."""
    return F.regexp_extract(text, r"^(\d{4})(?!\d)", 1).try_cast("int")


#: Titles that tools write when nobody gave one, and authors that are a login, an office or a tool.
GENERIC_TITLES = [
    "untitled", "unknown", "document", "documento", "presentation", "powerpoint presentation", "(anonymous)", "anonymous", "no title", "title", "new document", "book1", "sheet1",
]
GENERIC_AUTHORS = [
    "anonymous", "(anonymous)", "administrator", "admin", "user", "windows user", "owner", "guest", "unknown", "author", "default", "none", "(none)",
    "camscanner", "adobe acrobat", "microsoft word", "pdfkit", "scansnap", "prince",
]
#: Names that tools make up, endings of files, identifiers of machines, licensees and logins.
NUMBERED_TITLE, TOOL_TITLE, FILE_ENDING = r"(?i)^(document|doc|file|untitled|book|sheet)\s*\d+$", r"(?i)^microsoft (word|powerpoint|excel) - ", r"(?i)\.(pdf|docx?|indd|pptx?|odt|rtf|tex|qxd|fm|pages|epub)$"
IDENTIFIER, LICENSEE, LOGIN = r"_(\S|$)", r"(?i)^registered to\s*:", r"^[A-Z]{2}[a-z]+$"


def _mostly_letters(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return (letters >= 3) & (2 * letters >= F.length(F.regexp_replace(text, r"(?U)\s", "")))


def usable_title(raw: Column) -> Column:
    """A declared title without its file's ending, or null if a tool made it up."""
    title = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(title, FILE_ENDING, ""), r"(?U)\s+$", "")
    made_up = F.lower(title).isin(GENERIC_TITLES) | F.regexp_like(title, F.lit(NUMBERED_TITLE)) | F.regexp_like(title, F.lit(TOOL_TITLE)) | F.regexp_like(bare, F.lit(IDENTIFIER))
    return F.when(~made_up & _mostly_letters(bare), bare)


def usable_author(raw: Column) -> Column:
    """A declared author, or null if that is a login, an office, a licensee or a tool."""
    author = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    no_name = F.lower(author).isin(GENERIC_AUTHORS) | F.regexp_like(author, F.lit(LICENSEE)) | F.regexp_like(author, F.lit(IDENTIFIER)) | F.regexp_like(author, F.lit(LOGIN))
    return F.when(~no_name & _mostly_letters(author), author)
