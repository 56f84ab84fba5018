"""Fuzzy dates: phrases to inclusive intervals with a precision, JVM-side; dates inside scanned text, by an Arrow scan."""

from __future__ import annotations

import calendar
import datetime
import difflib
import functools
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: Spellings of months in letters, of seasons (first and last month) and of months misread by a scanner.
MONTHS = {
    "january": 1, "jan": 1, "jany": 1, "janr": 1, "february": 2, "feb": 2, "feby": 2, "febr": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5,
    "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "sepr": 9, "october": 10, "oct": 10, "octr": 10,
    "november": 11, "nov": 11, "novr": 11, "december": 12, "dec": 12, "decr": 12,
}
SEASON_MONTHS = {"spring": (3, 5), "summer": (6, 8), "autumn": (9, 11), "fall": (9, 11), "winter": (12, 2)}
MISREAD = {
    "dee": 12, "deo": 12, "dec'": 12, "jime": 6, "jnne": 6, "jnue": 6, "jnly": 7, "julv": 7, "angust": 8, "augnst": 8, "marcli": 3, "mareh": 3, "mareli": 3,
    "febmary": 2, "febrnary": 2, "jaimary": 1, "jannary": 1, "aprii": 4, "apl": 4, "apnl": 4, "oet": 10, "octr": 10, "xov": 11, "novr": 11, "sepr": 9, "sepc": 9,
}
#: Least likeness of a misread month, characters after a day in which its year is looked for, full years.
MONTH_LIKENESS, YEAR_WINDOW = 0.75, 22
FULL_YEAR = r"\b(1[5-9]\d{2}|20\d{2})\b"

#: Words that come with a date; the first line is an extension, approximate dates being read as dates.
_LEAD = (
    r"^(?:(?:circa|ca\.?|c\.|about|around|probably|early|mid|late|in"
    r"|yours?\s+(?:\w+\s+){0,3}of|letters?\s+of|in\s+reply\s+to|received|acknowledg\w*|dated|written|on|of|the)\s+)+"
)
_WEEK = r"^week\s+of\s+"
_NAME, _DAY, _YEAR = r"([a-z]+)\.?", r"(\d{1,2})(?:st|nd|rd|th|d)?", r"(\d{4})"
#: Form: pattern, groups of year, month and day (0: none).  The first that fits counts; those after ``year`` need an anchor.
FORMS = {
    "iso": (rf"^{_YEAR}-(\d{{1,2}})-(\d{{1,2}})$", 1, 2, 3),
    "numeric": (rf"^(\d{{1,2}})[/.](\d{{1,2}})[/.]{_YEAR}$", 3, 1, 2),
    "month day year": (rf"^{_NAME}\s+{_DAY}\s*,?\s*{_YEAR}$", 3, 1, 2),
    "day month year": (rf"^{_DAY}\s+(?:of\s+)?{_NAME}\s*,?\s*{_YEAR}$", 3, 2, 1),
    "season": (rf"^(spring|summer|autumn|fall|winter)\s+(?:of\s+)?{_YEAR}$", 2, 1, 0),
    "month": (rf"^{_NAME}\s*,?\s*{_YEAR}$", 2, 1, 0),
    "decade": (r"^(\d{3})0\s*'?s$", 1, 0, 0),
    "year": (rf"^{_YEAR}$", 1, 0, 0),
    "today": (r"^(?:today|to-day|this day)$", 0, 0, 0),
    "yesterday": (r"^yesterday$", 0, 0, 0),
    "near month": (rf"^{_DAY}\s*(ult|inst|prox)(?:o|imo|ant)?\.?$", 0, 2, 1),
    "bare day": (rf"^{_DAY}$", 0, 0, 1),
    "month day": (rf"^{_NAME}\s+{_DAY}$", 0, 1, 2),
    "day month": (rf"^{_DAY}\s+{_NAME}$", 0, 2, 1),
}
ANCHORED = ("today", "yesterday", "near month", "bare day", "month day", "day month")
PRECISION = {"season": "season", "month": "month", "decade": "decade", "year": "year"}


def _lookup(values: dict, key: Column) -> Column:
    """The value of a fixed table, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def month_number(name: Column) -> Column:
    """1-12 of a month as letters spell it, null otherwise."""
    return _lookup(MONTHS, F.lower(F.regexp_replace(name, r"\.$", "")))


def _date(y: Column, m: Column, d: Column) -> Column:
    """A valid calendar date, else null (never an error)."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def _bound(value: Column, *steps) -> Column:
    """``value`` through the steps; one-element arrays bind each, so that later ones don't repeat its expression."""
    out = F.array(value)
    for step in steps:
        out = F.transform(out, step)
    return F.element_at(out, 1)


def parse(phrase: Column, anchor: Column | None = None) -> Column:
    """struct(start date, end date, precision) of a phrase, null fields if it isn't a date.

    Forms are those of :data:`FORMS`, and ``week of`` before any of them (seven days).  ``anchor`` is the date of the
    letter: ``15th ult.`` is of the month before, ``inst.`` of its own, ``prox.`` of the next; a day alone is of its own
    month, or the month before if still to come; a month and day without a year are the last such month.  Without an
    anchor these forms are refused, and so is an impossible day.
    """
    return _parsed(phrase, F.lit(None).cast("date") if anchor is None else anchor, _closed)


def _parsed(phrase: Column, anchor: Column, last) -> Column:
    """``last`` of struct(start, kind, week, near): the first day, the precision, whether a week is meant, whether the form needs an anchor."""
    clean = lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), _LEAD, "")), r"[,.]+$", "")
    names = list(FORMS)

    def unweek(p: Column) -> Column:
        week = F.regexp_like(p, F.lit(_WEEK))
        return F.struct(F.when(week, clean(F.regexp_replace(p, _WEEK, ""))).otherwise(p).alias("p"), week.alias("week"))

    def form(r: Column) -> Column:
        which = F.coalesce(*[F.when(F.regexp_like(r["p"], F.lit(FORMS[n][0])), F.lit(i)) for i, n in enumerate(names, 1)])
        return F.struct(r["p"].alias("p"), r["week"].alias("week"), which.alias("i"))

    def read(r: Column) -> Column:
        # Each form's own pattern is a literal, compiled once; one looked up by form would be compiled anew for each row.
        part = lambda i: F.coalesce(*[F.when(r["i"] == n, F.regexp_extract(r["p"], f[0], f[i])) for n, f in enumerate(FORMS.values(), 1) if f[i]])
        return F.struct(
            F.element_at(F.array(*[F.lit(n) for n in names]), r["i"]).alias("form"), r["week"].alias("week"), part(1).try_cast("int").alias("y"), part(2).alias("m"), part(3).try_cast("int").alias("d")
        )

    def start(r: Column) -> Column:
        is_form = lambda *n: r["form"].isin(*n)
        shift = F.when(is_form("bare day"), F.when(r["d"] > F.day(anchor), -1).otherwise(0)).otherwise(_lookup({"ult": -1, "inst": 0, "prox": 1}, r["m"]))
        near = F.add_months(F.trunc(anchor, "month"), shift)
        named = F.coalesce(r["m"].try_cast("int"), month_number(r["m"]))
        month = F.when(is_form("decade", "year"), F.lit(1)).when(is_form("season"), _lookup({s: a for s, (a, _) in SEASON_MONTHS.items()}, r["m"]))
        month = month.when(is_form("near month", "bare day"), F.month(near)).otherwise(named)
        year = F.when(is_form("decade"), r["y"] * 10).when(is_form("near month", "bare day"), F.year(near))
        year = year.when(is_form("month day", "day month"), F.year(anchor) - F.when(named > F.month(anchor), 1).otherwise(0)).otherwise(r["y"])
        whole = F.when(year.isNotNull() & month.isNotNull(), _date(year, month, F.when(is_form(*PRECISION), F.lit(1)).otherwise(r["d"])))
        at = F.when(is_form("today"), anchor).when(is_form("yesterday"), F.date_sub(anchor, 1)).otherwise(whole)
        return F.struct(at.alias("start"), F.coalesce(_lookup(PRECISION, r["form"]), F.lit("day")).alias("kind"), r["week"].alias("week"), is_form(*ANCHORED).alias("near"))

    return _bound(clean(F.lower(phrase)), unweek, form, read, start, last)


def _closed(r: Column) -> Column:
    last = F.last_day(F.add_months(r["start"], _lookup({"season": 2, "month": 0, "year": 11, "decade": 119}, r["kind"])))
    end = F.when(r["week"], F.date_add(r["start"], 6)).when(r["kind"] == "day", r["start"]).otherwise(last)
    kind = F.when(r["week"], F.lit("week")).otherwise(r["kind"])
    return F.struct(r["start"].alias("start"), end.alias("end"), F.when(r["start"].isNotNull(), kind).alias("precision"))


def anchored(phrase: Column, anchor: Column) -> Column:
    """The day of a phrase that needs the letter's date; null for other phrases."""
    return _parsed(phrase, anchor, lambda r: F.when(r["near"] & (r["kind"] == "day") & ~r["week"], r["start"]))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether two inclusive intervals meet; a null bound is unbounded."""
    return (end.isNull() | low.isNull() | (end >= low)) & (start.isNull() | high.isNull() | (start <= high))


def full_years(text: Column) -> Column:
    """Every four-digit year (1000-2099) in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(1\d{3}|20\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))


def century_of(years: list[str]) -> int | None:
    """The century (1800) of at least half of a text's years, five at least, ties to the first met; else None."""
    best = Counter(int(y) // 100 * 100 for y in years).most_common(1)
    return best[0][0] if len(years) >= 5 and 2 * best[0][1] >= len(years) else None


@functools.lru_cache(maxsize=4096)
def damaged_month(word: str) -> int | None:
    """1-12 of a month's name that a scanner may have damaged, else None."""
    word = word.strip(".").lower()
    known = MONTHS.get(word) or MISREAD.get(word)
    if known:
        return known
    like = difflib.get_close_matches(word, MONTHS, n=1, cutoff=MONTH_LIKENESS)
    return MONTHS[like[0]] if like else None


SCANNED = Ty.ArrayType(Ty.StructType([Ty.StructField("char_start", Ty.IntegerType()), Ty.StructField("char_end", Ty.IntegerType()), Ty.StructField("day", Ty.DateType())]))
#: A word and a day, with what an editor or a scanner puts between; a short year, after a slash only.
_DATELINE = re.compile(r"\b([A-Za-z]{3,9})\.?[\s\]\)\[\(\|,]{0,4}(\d{1,2})(?:st|nd|rd|th|d)?\.?")
_SHORT_YEAR = re.compile(r"[\s\]\)\[\(\|,]{0,3}/\s?(\d{2})\b")
ANY_YEAR = re.compile(FULL_YEAR)


def stated(text: str, century: int | None) -> list[tuple[int, int, datetime.date]]:
    out = []
    for hit in _DATELINE.finditer(text):
        month, day, after = damaged_month(hit[1]), int(hit[2]), text[hit.end() : hit.end() + YEAR_WINDOW]
        if month is None:
            continue
        full, short = ANY_YEAR.search(after), _SHORT_YEAR.match(after)
        if full:
            year, length = int(full[1]), full.end()
        elif short and century is not None:
            year, length = century + int(short[1]), short.end()
        else:
            continue
        if 1 <= day <= calendar.monthrange(year, month)[1]:
            out.append((hit.start(), hit.end() + length, datetime.date(year, month, day)))
    return out


@F.pandas_udf(SCANNED)
def scan(texts: pd.Series) -> pd.Series:
    """Dates that a text states, in its order: array of struct(char_start, char_end, day); null text gives none.

    A word that may be a month (damaged ones too), a day, and a full year shortly after, or else a short year after
    a slash, of the century that the text's full years are of.
    """
    return texts.map(lambda t: stated(t, century_of(ANY_YEAR.findall(t))) if t else [])
