"""Main text of web pages by nearest-URL page differencing.

Each page becomes text lines, one per block.  Pages are ordered by host and URL
path, so each meets the nearest page of its host on either side whose html
differs; the lines are aligned by longest common subsequence, and lines that
are shared, the template, are deleted:

* lines that both neighbours share go, and lines that the only neighbour shares;
* lines that one of two neighbours shares go too, unless they are most of what
  is left, which makes that neighbour a near copy rather than a page with the
  same template;
* inside an article that markup declares, lines go only in a run that both
  neighbours share at its very beginning or end, of lines up to ``SIGN_OFF``
  characters (share bars, sign-offs), and only if neither neighbour shares more
  than half of the article, so that what articles have in common stays.

If differencing leaves nothing of a page, its lines before differencing stay.

Markup decides only what differencing can't see, as it may differ from page to
page: elements that are never article text (scripts, menus, footers, asides,
buttons, hidden ones) are left out, and so are forms and elements whose class,
id or role names a menu, notice, advert or comment list, unless hardly anything
or no declared article is left without them.  Declared articles (article or
main element) are taken alone if they hold ``MAIN_SHARE`` of what is left or
``MAIN_CHARS`` characters; next to shorter ones (cards), the other lines stay.

The order is cut into ranges.  Each range gets the pages just outside it that
its first and last pages need, so results don't depend on how pages are dealt.

Defined results: null html gives the empty text; a page whose host has no other
page is judged by markup alone; an unparsable url belongs to the empty host;
repeated rows are copies of each other and get the same text; an empty table
gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, small_batches

SIGN_OFF = 60
MAIN_SHARE, MAIN_CHARS = 0.2, 250
NEUTRAL, MAIN = 1, 2
#: Bytes of html in a range, how many ranges there are at most (larger inputs get larger ranges, which are streamed), and ranges a task.
RANGE_BYTES, MOST_RANGES, RANGES_A_TASK = 8 << 20, 40_000, 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|select|svg|math|iframe|object|title|head)\b(?P<rawattr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.S | re.I,
)
#: HTML elements by their role.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = set("nav footer aside menu dialog button".split())
_FORM = {"form", "fieldset"}
_MAIN = {"article", "main"}
#: Words that name a part of a page other than its article, and words that may stand beside them in such a name.
_PARTS = set(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer sidebar widget related recommended "
    "share sharing social comment comments disqus respond replies cookie cookies consent gdpr notice alert newsletter subscribe signup login modal popup overlay search pagination pager toolbar "
    "skip complementary contentinfo".split()
)
_HEADS = {"header", "head", "heading"}
_BESIDE = set("section area list container wrapper wrap box block bar slot unit top bottom left right site page global primary secondary inner outer links link form thread items item group the".split())
_ATTR = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[-_\d]+")


def _names_a_part(value: str, inside_main: bool) -> bool:
    """Whether a class, id or role value has a name that is made of such words only."""
    for name in value.lower().split():
        words = set(filter(None, _NAME.split(name)))
        if words & _PARTS and words <= _PARTS | _BESIDE | _HEADS:
            return True
        if not inside_main and words & _HEADS and words & {"site", "page", "global"} and words <= _BESIDE | _HEADS:
            return True
    return False


def _declares(tag: str, attr: str, inside_main: bool) -> str | None:
    """What an element is declared to be: never (article text), part (most likely none), main, or nothing."""
    if tag in _NEVER or (tag == "header" and not inside_main):
        return "never"
    found = "part" if tag in _FORM else None
    for name, a, b, c in _ATTR.findall(attr) if attr else ():
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"(?i)display\s*:\s*none", value)):
            return "never"
        if name in ("class", "id", "role") and tag not in _MAIN and tag not in ("html", "body") and _names_a_part(value, inside_main):
            found = "part"
        if not found and ((name == "role" and value.lower() in ("main", "article")) or (name == "itemprop" and value.lower() == "articlebody")):
            found = "main"
    return found or ("main" if tag in _MAIN else None)


Line = tuple[int, str]


def page_lines(page: str) -> list[Line]:
    """(region, line) of each block of a page that may be article text, in order, white space collapsed and references decoded."""
    out: list[tuple[int, tuple[int, ...], str]] = []
    stack: list[tuple[str, tuple]] = []
    state: tuple = (NEUTRAL, (), False)  # region, the parts around, whether inside what is never article text
    parts_seen, pos, pieces = 0, 0, []

    def flush() -> None:
        if pieces:
            line = "" if state[2] else _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            if line:
                out.append((state[0], state[1], line))
            pieces.clear()

    end = len(page)
    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            pieces.append(page[pos:])
            break
        if m.start() > pos:
            pieces.append(page[pos : m.start()])
        pos = m.end()
        raw, tag = m["raw"], m["tag"]
        if raw:
            if raw.lower() == "head":
                # A head that never ends stops at the body.
                stop = re.compile(r"(?i)</head\s*>|(?=<body\b)").search(page, pos)
            else:
                stop = re.compile(rf"(?i)</{raw}\s*>").search(page, pos)
            flush()
            if not m["rawattr"].endswith("/"):
                pos = stop.end() if stop else (end if raw.lower() in ("script", "style") else pos)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush()
        if m["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if stack[depth][1] != state and tag in _INLINE:
                        flush()
                    state = stack[depth][1]
                    del stack[depth:]
                    break
            continue
        if tag in _VOID or (m["attr"] or "").endswith("/"):
            continue
        found = _declares(tag, m["attr"], state[0] == MAIN)
        if tag in ("p", "li", "b", "i", "span", "a", "td", "tr", "option", "dt", "dd") and found is None:
            continue  # often left open, and of no consequence
        stack.append((tag, state))
        if found:
            if tag in _INLINE:
                flush()
            if found == "part":
                parts_seen += 1
            state = (MAIN if found == "main" else state[0], (*state[1], parts_seen) if found == "part" else state[1], state[2] or found == "never")
    flush()
    return _without_parts(out, parts_seen)


def _without_parts(lines: list[tuple[int, tuple[int, ...], str]], parts: int) -> list[Line]:
    """Leave out the lines of declared parts, outer ones first, but for parts that hold the article."""
    for part in range(1, parts + 1):
        sizes = {(inside, main): 0 for inside in (True, False) for main in (True, False)}
        for region, around, text in lines:
            # What is outside counts only if no other part is around it.
            if part in around or not [x for x in around if x > part]:
                sizes[(part in around, region == MAIN)] += len(text)
        inside, outside = (sizes[(i, True)] + sizes[(i, False)] for i in (True, False))
        if not inside:
            continue
        holds = not sizes[(False, True)] and (sizes[(True, True)] > 0 or 9 * outside < inside)
        lines = [(r, tuple(x for x in around if x != part), t) if holds else (r, around, t) for r, around, t in lines if holds or part not in around]
    return [(r, t) for r, _, t in lines]


def shared_lines(a: list[str], b: list[str]) -> np.ndarray:
    """Which lines of ``a`` a longest common subsequence with ``b`` matches."""
    hit = np.zeros(len(a), dtype=bool)
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi_a, hi_b = len(a), len(b)
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    hit[:lo] = hit[hi_a:] = True
    common = set(a[lo:hi_a]) & set(b[lo:hi_b])
    x = [i for i in range(lo, hi_a) if a[i] in common]
    y = [b[j] for j in range(lo, hi_b) if b[j] in common]
    if x and y:
        hit[_lcs(x, [a[i] for i in x], y)] = True
    return hit


def _lcs(index: list[int], a: list[str], b: list[str]) -> list[int]:
    """Indexes of ``a``'s lines in one longest common subsequence (bit-parallel rows, then traced back).

    Long pages are halved at a best split of ``b`` first (Hirschberg), which bounds the kept rows.
    """
    if not a or not b:
        return []
    if len(a) == 1:
        return index if a[0] in b else []
    if len(a) * len(b) > 1 << 26:
        half = len(a) // 2
        ahead, back = _row_lengths(a[:half], b), _row_lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: ahead[j] + back[j])
        return _lcs(index[:half], a[:half], b[:cut]) + _lcs(index[half:], a[half:], b[cut:])
    rows, full, row = [], (1 << len(b)) - 1, 0
    where = _places(b)
    row = full
    for line in a:
        rows.append(row)
        match = row & where.get(line, 0)
        row = ((row + match) | (row - match)) & full
    found, j = [], len(b)
    rows.append(row)
    # rows[i] has a 0 bit at j where the length for (a[:i], b[:j + 1]) exceeds that for b[:j].
    for i in range(len(a), 0, -1):
        zeros = ~rows[i] & ((1 << j) - 1)
        before = ~rows[i - 1] & ((1 << j) - 1)
        if zeros.bit_count() > before.bit_count():
            # a[i - 1] is matched: at its last place that keeps the length before it.
            want = before.bit_count()
            place = where.get(a[i - 1], 0) & ((1 << j) - 1)
            while place:
                k = place.bit_length() - 1
                if (before & ((1 << k) - 1)).bit_count() == want:
                    found.append(index[i - 1])
                    j = k
                    break
                place ^= 1 << k
    return found[::-1]


def _places(b: list[str]) -> dict[str, int]:
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    return where


def _row_lengths(a: list[str], b: list[str]) -> list[int]:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``."""
    full, where = (1 << len(b)) - 1, _places(b)
    row = full
    for line in a:
        match = row & where.get(line, 0)
        row = ((row + match) | (row - match)) & full
    out, n = [0], 0
    for j in range(len(b)):
        n += not row >> j & 1
        out.append(n)
    return out


def _template(texts: list[str], hits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(gone, both): which lines differencing deletes, and which both of two neighbours share."""
    nothing = np.zeros(len(texts), dtype=bool)
    if not hits:
        return nothing, nothing
    if len(hits) == 1:
        return hits[0], nothing
    sizes = np.array([len(t) for t in texts])
    both = hits[0] & hits[1]
    gone = both.copy()
    for hit in hits:
        only = hit & ~both
        if 2 * sizes[only].sum() < sizes[~both].sum():
            gone |= only
    return gone, both


def main_text(lines: list[Line], neighbours: list[list[Line]]) -> str:
    """The lines of a page that are its article, joined by one space."""
    texts = [t for _, t in lines]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    main = np.array([r == MAIN for r, _ in lines], dtype=bool)
    hits = [shared_lines(texts, [t for _, t in n]) for n in neighbours if n != lines]
    gone, both = _template(texts, hits)
    inside = np.flatnonzero(main)
    # From near copies nothing can be learned about the article.
    strange = all(2 * sizes[hit & main].sum() <= sizes[main].sum() for hit in hits)
    agreed = both[inside] & (sizes[inside] <= SIGN_OFF) & strange
    edge = np.logical_and.accumulate(agreed) | np.logical_and.accumulate(agreed[::-1])[::-1]
    if not edge.all():
        gone = gone & ~main
        gone[inside[edge]] = True
    elif main.any():
        gone = gone & ~main
    left = ~gone
    held = sizes[left & main].sum()
    if held and held >= min(MAIN_CHARS, MAIN_SHARE * sizes[left].sum()):
        left &= main
    return " ".join(t for t, k in zip(texts, left if left.any() else ~left, strict=True) if k)


_KEY = ["host", "path", "page_id", "digest"]


def _order(key) -> tuple:
    """A page's place in the order: nulls first, as Spark sorts them, and strings by their bytes."""
    host, path, page_id, digest = key
    return host.encode(), path.encode(), (0, 0) if page_id is None else (1, page_id), digest


def _ranges(keys: DataFrame, count: int) -> tuple[list[tuple], DataFrame]:
    """(first places of the ranges, halo): halo has a row per range and page outside it that its pages need.

    A range is summed up by its first and last page, and the nearest pages to
    these of the same host with other html; the driver sees these four keys of each range.
    """

    def ends(batches):
        first = second = last = before = None
        for pdf in batches:
            for key in zip(*(pdf[c] for c in _KEY), strict=True):
                key = (key[0], key[1], None if pd.isna(key[2]) else int(key[2]), int(key[3]))
                if first is None:
                    first = key
                if second is None and key[0] == first[0] and key[3] != first[3]:
                    second = key
                if last is not None and key[0] != last[0]:
                    before = None
                elif last is not None and key[3] != last[3]:
                    before = last
                last = key
        if first is not None:
            pick = lambda k: None if k is None else {"host": k[0], "path": k[1], "page_id": k[2], "digest": k[3]}
            yield pd.DataFrame({"first": [pick(first)], "second": [pick(second)], "last": [pick(last)], "before": [pick(before)]})

    place = "struct<host:string,path:string,page_id:long,digest:long>"
    summed = keys.repartitionByRange(count, *_KEY).sortWithinPartitions(*_KEY).mapInPandas(ends, f"first {place}, second {place}, last {place}, before {place}")
    found = sorted(((*(None if r[c] is None else tuple(r[c]) for c in ("first", "second", "last", "before")),) for r in summed.collect()), key=lambda r: _order(r[0]))
    halo: list[tuple] = []
    for sign, run in ((1, range(len(found))), (-1, range(len(found) - 1, -1, -1))):
        # near: the page next to the range under way; far: the nearest of that host with other html.
        near = far = None
        for i in run:
            first, second, last, before = found[i]
            head, head2, tail, tail2 = (first, second, last, before) if sign > 0 else (last, before, first, second)
            if near is not None and near[0] == head[0]:
                halo += [(i, *near)] + ([(i, *far)] if far is not None else [])
            if tail2 is None and head[0] == tail[0] and near is not None and near[0] == tail[0]:
                # The range is one run of copies: look beyond it.
                tail2 = near if near[3] != tail[3] else far
            near, far = tail, tail2
    return [r[0] for r in found], keys.sparkSession.createDataFrame(halo, "part int, host string, path string, page_id long, digest long").distinct()


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (its main text), n_chars (code points)."""
    spark = pages.sparkSession
    small_batches(spark, "8m")
    url = F.coalesce("url", F.lit(""))
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.substring_index(F.substring_index(F.substring_index(bare, "/", 1), "?", 1), "#", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1), r"(?:/|\.html?)$", "")
    html = F.coalesce("html", F.lit(""))
    located = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), F.xxhash64(html).alias("digest"), html.cast("binary").alias("html"))
    keys = cut(located.select(*_KEY, F.octet_length("html").cast("long").alias("bytes")))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    parts = max(RANGES_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, total // RANGE_BYTES + 1))
    firsts, halo = _ranges(keys.select(*_KEY), parts)
    bounds = spark.sparkContext.broadcast([_order(k) for k in firsts])

    @F.pandas_udf("int")
    def part_of(host: pd.Series, path: pd.Series, page_id: pd.Series, digest: pd.Series) -> pd.Series:
        known = bounds.value
        return pd.Series([max(0, bisect.bisect_right(known, _order((h, p, None if pd.isna(i) else int(i), d))) - 1) for h, p, i, d in zip(host, path, page_id, digest, strict=True)], dtype="int32")

    own = located.withColumn("part", part_of(*_KEY)).withColumn("outside", F.lit(False))
    # Four rows a range at most: the driver made them.
    outside = located.join(F.broadcast(halo.select(F.col("part"), *[F.col(c).alias(f"__{c}") for c in _KEY])), (F.col("digest") == F.col("__digest")) & (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")) & F.col("page_id").eqNullSafe(F.col("__page_id")))
    near = own.unionByName(outside.drop(*[f"__{c}" for c in _KEY]).withColumn("outside", F.lit(True)))

    def differ(batches):
        def rows():
            for pdf in batches:
                for row in zip(*(pdf[c] for c in ("part", "host", "digest", "outside", "page_id", "url", "html")), strict=True):
                    yield row

        # Runs of copies: a run is settled once the next one in order is known.
        out: list[tuple] = []
        last = held = None  # (part and host, lines, rows of the run)
        for (where, _), run in groupby(rows(), key=lambda r: ((r[0], r[1]), r[2])):
            lines, wanted = None, []
            for row in run:
                if lines is None:
                    lines = page_lines(row[6].decode("utf-8", "replace"))
                if not row[3]:
                    wanted.append((row[4], row[5]))
            now = (where, lines, wanted)
            yield from _settle(last, held, now, out)
            last, held = held, now
        yield from _settle(last, held, None, out)
        if out:
            yield _frame(out)

    shuffled = near.repartition(-(-parts // RANGES_A_TASK), "part").sortWithinPartitions("part", *_KEY, "url")
    return shuffled.select("part", "host", "digest", "outside", "page_id", "url", "html").mapInPandas(differ, "page_id long, url string, text string, n_chars long")


def _settle(last, held, now, out: list[tuple]):
    """Add the texts of the run ``held`` to ``out``, and yield that as a frame when it is long enough."""
    if held is None:
        return
    where, lines, wanted = held
    if wanted:
        text = main_text(lines, [x[1] for x in (last, now) if x is not None and x[0] == where])
        for page_id, url in wanted:
            out.append((page_id, url, text))
            if len(out) >= 2000:
                yield _frame(out)


def _frame(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["page_id", "url", "text"])
    frame["page_id"], frame["n_chars"] = frame["page_id"].astype("Int64"), frame["text"].str.len().astype("Int64")
    out.clear()
    return frame
