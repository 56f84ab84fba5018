"""Verses read back out of chapters' texts, by the layout of their edition, and what passages and words cover of them.

A reading is trusted only if it claims the whole text: what is left between its
regions must be marks and white space.  A chapter that can't be read so is
refused as a whole, never guessed at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from scriptorium.operators import spans

#: What separates blocks, the space after a running verse number, and what may stand between regions in each layout.
SEPARATOR, AFTER_NUMBER = "\n\n \n\n", "\xa0"
GAPS = {
    "labelled": r"\s*(?:(?:\d+ )?\d+ \t)?\s*",
    "running": r"\s*(?:\[\[)?\s*(?:\d+\xa0\s*)?(?:\]\])?\s*",
    "unmarked": r"\s*",
}
_NUMBER = re.compile(rf"(\d+){AFTER_NUMBER}")
_CLOSES = tuple(".!?;,:”’\"')-—")
HEBREW = r"[א-ת]"


class Region(NamedTuple):
    kind: str
    number: int | None
    start: int
    end: int
    title: str | None = None


def _blocks(text: str, separator: str) -> Iterator[tuple[int, str]]:
    at = 0
    for block in text.split(separator):
        yield at, block
        at += len(block) + len(separator)


def _worded(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without white space at its ends; empty at its start if that is all there is."""
    own = text[start:end]
    if not own.strip():
        return start, start
    return start + len(own) - len(own.lstrip()), start + len(own.rstrip())


def labelled(text: str, chapter: int) -> list[Region] | None:
    """A verse a block, each after its number and a tab; the first block may also name the chapter."""
    out = []
    for at, block in _blocks(text, SEPARATOR):
        named = None if out else re.match(rf"{chapter} (\d+) \t", block)
        label = named or re.match(r"(\d+) \t", block)
        if not label:
            return None
        out.append(Region("verse", int(label[1]), at + label.end(), at + max(label.end(), len(block.rstrip()))))
    return out


def unmarked(text: str, chapter: int = 0) -> list[Region]:
    """Blocks between blank lines, counted from one."""
    worded = [(at, block) for at, block in _blocks(text, "\n\n") if block.strip()]
    return [Region("verse", n, *_worded(text, at, at + len(block))) for n, (at, block) in enumerate(worded, 1)]


def _is_heading(block: str, after: str) -> bool:
    """Whether every sign agrees: not indented, unnumbered, begins a sentence, doesn't end within or with one, and what follows doesn't go on with it."""
    own, then = block.strip(), after.strip()
    return not (block.startswith("\t") or _NUMBER.search(block) or not own[:1].isupper() or re.sub(r"\d+$", "", own).endswith(_CLOSES) or then[:1].islower())


def running(text: str, chapter: int) -> list[Region] | None:
    """Numbered verses within paragraphs, headings between them.

    The first number is the chapter's; where 1 follows it, it opens an unnumbered
    superscription.  Blocks before the first number are headings; later ones only
    if the next block opens with a number and every sign agrees (:func:`_is_heading`),
    since a heading inside a verse does less harm than a verse taken for a heading.
    A first number that is above the second, with 1 after it, is a verse of the
    chapter before.
    """
    blocks = [(at, block) for at, block in _blocks(text, SEPARATOR) if block.strip()]
    numbered = [bool(_NUMBER.search(block)) for _, block in blocks]
    if True not in numbered:
        return None
    opening = numbered.index(True)
    follows = [block for _, block in blocks[1:]] + [None]
    head = [
        i < opening or (not numbered[i] and follows[i] is not None and re.match(rf"\t*\d+{AFTER_NUMBER}", follows[i]) is not None and _is_heading(block, follows[i]))
        for i, (_, block) in enumerate(blocks)
    ]
    marks = [(at + m.start(), at + m.end(), int(m[1])) for (at, block), heading in zip(blocks, head, strict=True) if not heading for m in _NUMBER.finditer(block)]
    numbers = [n for _, _, n in marks]
    if not marks or numbers[0] != chapter:
        return None
    foreign = len(numbers) > 2 and numbers[2] == 1 < numbers[1]
    superscribed = not foreign and numbers[1:2] == [1]
    counted = numbers[2:] if foreign else numbers[1:] if superscribed else [1, *numbers[1:]]
    if counted[0] != 1 or any(a >= b for a, b in pairwise(counted)):
        return None
    heads = [at for (at, _), heading in zip(blocks, head, strict=True) if heading]
    out = [Region("heading", None, *_worded(text, at, at + len(block)), block.strip()) for (at, block), heading in zip(blocks, head, strict=True) if heading]
    for i, (_, start, number) in enumerate(marks):
        end = marks[i + 1][0] if i + 1 < len(marks) else len(text)
        span = _worded(text, start, min([end, *(h for h in heads if start < h < end)]))
        if i == 0 and superscribed:
            out.append(Region("superscription", None, *span, "superscription"))
        elif foreign and i < 2:
            out.append(Region(("bracket", "foreign_verse")[i], (None, number)[i], *span))
        else:
            out.append(Region("verse", number if i else 1, *span))
    return sorted(out, key=lambda r: r.start)


LAYOUTS: dict[str, Callable[[str, int], list[Region] | None]] = {"labelled": labelled, "running": running, "unmarked": unmarked}


def unclaimed(text: str, regions: list[Region], between: str) -> list[str]:
    """What no region claims and ``between`` doesn't allow, and where regions overlap."""
    faults, at = [], 0
    for r in [*sorted(regions, key=lambda r: r.start), Region("end", None, len(text), len(text))]:
        if r.start < at:
            faults.append(f"overlap at {r.start}")
            continue
        if not re.fullmatch(between, text[at : r.start]):
            faults.append(text[at : r.start][:60])
        at = r.end
    return faults


_REGION = Ty.StructType([Ty.StructField("kind", Ty.StringType()), Ty.StructField("number", Ty.IntegerType()), Ty.StructField("char_start", Ty.IntegerType()), Ty.StructField("char_end", Ty.IntegerType()), Ty.StructField("title", Ty.StringType())])
_READ = Ty.StructType([Ty.StructField("regions", Ty.ArrayType(_REGION)), Ty.StructField("faults", Ty.ArrayType(Ty.StringType()))])


def read_chapters(chapters: DataFrame, layout: str) -> DataFrame:
    """``chapters(doc_id, chapter, text)`` with their regions, or none and what speaks against the reading (``faults``)."""
    parse, between = LAYOUTS[layout], GAPS[layout]

    @F.pandas_udf(_READ)
    def read(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        out = []
        for text, number in zip(texts, numbers, strict=True):
            regions = None if text is None or pd.isna(number) else parse(text, int(number))
            faults = ["no such layout"] if regions is None else unclaimed(text, regions, between)
            out.append(([] if faults else [tuple(r) for r in regions], faults))
        rows = [[dict(zip(_REGION.names, r, strict=True)) for r in regions] for regions, _ in out]
        return pd.DataFrame({"regions": pd.Series(rows, dtype="object"), "faults": pd.Series([f for _, f in out], dtype="object")})

    return chapters.withColumn("read", read("text", "chapter")).select("doc_id", "chapter", "read.regions", "read.faults")


def regions(read: DataFrame) -> DataFrame:
    """One row a region of the chapters that could be read."""
    return read.select("doc_id", "chapter", F.explode("regions").alias("r")).select("doc_id", "chapter", "r.*")


def verses_of(passages: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """(passage_id, verses): the numbers of the verses of which each of ``passages(passage_id, doc_id, char_start, char_end)`` shows a visible character."""
    left = passages.select("passage_id", "doc_id", F.col("char_start").alias("l_start"), F.col("char_end").alias("l_end"))
    right = found.where("kind = 'verse'").select("doc_id", F.col("number").alias("verse"), F.col("char_start").alias("r_start"), F.col("char_end").alias("r_end"))
    met = spans.overlap_join(left, right).join(texts.select("doc_id", "text"), "doc_id")
    low, high = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    seen = met.where(F.regexp_like(F.substring("text", low + 1, high - low), F.lit(r"(?U)[^\s\u001C-\u001F]")))
    return seen.groupBy("passage_id").agg(F.sort_array(F.collect_set("verse")).alias("verses"))


def locators(of: DataFrame, book: Column, chapter: Column) -> DataFrame:
    """``of(passage_id, verses, ...)`` with a locator such as ``Gen 3:2-5`` or ``Gen 3:2``; null without a verse."""
    first, last = F.array_min("verses"), F.array_max("verses")
    number = F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), first.cast("string"), F.when(last > first, F.concat(F.lit("-"), last.cast("string"))).otherwise(F.lit("")))
    return of.withColumn("locator", F.when(F.size("verses") > 0, number))


def unclaimed_letters(words: DataFrame, texts: DataFrame, marks: DataFrame | None = None, letter: str = HEBREW) -> DataFrame:
    """(doc_id, char_start, gap): stretches of a text that no span of ``words`` or ``marks (doc_id, char_start, char_end)`` claims and that hold a letter."""
    claimed = words.select("doc_id", "char_start", "char_end")
    claimed = claimed if marks is None else claimed.union(marks.select("doc_id", "char_start", "char_end"))
    sized = texts.where("text is not null").select("doc_id", "text", F.length("text").alias("n"))
    ends = sized.select("doc_id", F.col("n").alias("char_start"), F.col("n").alias("char_end"))
    # Where spans overlap, a gap begins after the furthest end so far.
    before = Window.partitionBy("doc_id").orderBy("char_start", "char_end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = claimed.union(ends).withColumn("at", F.coalesce(F.max("char_end").over(before), F.lit(0))).where(F.col("at") < F.col("char_start"))
    quoted = gaps.join(sized, "doc_id").select("doc_id", F.col("at").alias("char_start"), F.substring("text", F.col("at") + 1, F.col("char_start") - F.col("at")).alias("gap"))
    return quoted.where(F.regexp_like("gap", F.lit(letter)))


_MAPPING = "from_ref string, from_part string, to_ref string, to_part string, kind string"


def verse_map(files: DataFrame, source: str = "wlc", target: str = "kjv") -> DataFrame:
    """Rows of verse-map files (``content``): references of two schemes, the part of a verse after ``!`` apart, and the kind of mapping (full unless stated)."""

    def rows(batches):
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                for verse in ElementTree.fromstring(content).iter():
                    if verse.tag.rpartition("}")[2] == "verse":
                        a, b = ((verse.get(side) or "").partition("!") for side in (source, target))
                        out.append((a[0], a[2] if a[1] else None, b[0], b[2] if b[1] else None, verse.get("type") or "full"))
            yield pd.DataFrame(out, columns=["from_ref", "from_part", "to_ref", "to_part", "kind"])

    return files.select("content").mapInPandas(rows, _MAPPING)
