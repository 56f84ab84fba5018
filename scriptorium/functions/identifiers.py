"""Identity of an edition from a document's own first page: DOI, JSTOR address, ISBN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import text as T

#: How identifiers are written, marks that may follow one, and characters of a first page without page bounds.
DOI = r"(?Ui)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"
JSTOR = r"(?i)https?://(?:www\.)?jstor\.org/stable/([^\s?#]+)"
ISBN = r"(?Ui)\bISBN(?:-1[03])?\s*:?[\s]*([0-9X][0-9X\-\s]{8,20}[0-9X])"
AFTER, AFTER_ADDRESS = r"[.,;:!?]+$", r"[.,;:!?)\]}]+$"
FIRST_PAGE = 12_000


def unquoted(value: Column) -> Column:
    """A percent-encoded text decoded; as it is if it can't be."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def doi(value: Column) -> Column:
    """The first DOI in a text, bare and in lower case, without the marks and brackets that close the sentence around it; null if there is none."""
    return T.bound(F.regexp_replace(F.regexp_extract(unquoted(value), DOI, 0), AFTER, ""), _bare_doi)


def _bare_doi(found: Column) -> Column:
    count = lambda mark: F.length(found) - F.length(F.replace(found, F.lit(mark), F.lit("")))
    unopened = F.least(F.length(F.regexp_extract(found, r"\)+$", 0)), F.greatest(count(")") - count("("), F.lit(0)))
    return F.when(found != "", F.lower(F.substring(found, F.lit(1), F.length(found) - unopened)))


def jstor(text: Column) -> Column:
    """The identifier in the first JSTOR address of a text; null if there is none."""
    address = T.bound(F.regexp_extract(text, JSTOR, 1), unquoted)
    return T.bound(F.lower(F.regexp_replace(address, AFTER_ADDRESS, "")), lambda x: F.nullif(x, F.lit("")))


def isbn(value: Column) -> Column:
    """A valid ISBN as 13 digits, whatever stands between its digits; null otherwise."""
    return T.isbn13(F.regexp_replace(F.upper(value), "[^0-9X]", ""))


def stated_isbn(text: Column) -> Column:
    """The first ISBN that a text calls one, if it is valid."""
    return isbn(T.bound(F.regexp_extract(text, ISBN, 1), lambda x: F.nullif(x, F.lit(""))))


def first_page(text: Column, second: Column) -> Column:
    """The text up to where the second page begins, or its first characters if that isn't known."""
    return F.when((second > 0) & (second <= F.length(text)), F.substring(text, F.lit(1), second)).otherwise(F.substring(text, 1, FIRST_PAGE))


def identity(page: Column, edition_key: Column, declared_doi: Column, declared_isbn: Column) -> Column:
    """(edition_key, doi, jstor_stable_url, isbn): a stated key as it is, else the first of DOI, JSTOR and ISBN that is declared or stands on the page.

    The page is searched once for each, and only for what those before it left open.
    """
    none = F.lit(None).cast("string")
    of = lambda key, **known: F.struct(key.alias("edition_key"), *[known.get(k, none).alias(k) for k in ("doi", "jstor_stable_url", "isbn")])
    as_doi = lambda x: of(F.concat(F.lit("doi:"), x), doi=x)
    as_jstor = lambda x: of(F.concat(F.lit("jstor:"), x), jstor_stable_url=F.concat(F.lit("https://www.jstor.org/stable/"), x))
    as_isbn = lambda x: of(F.concat(F.lit("isbn:"), x), isbn=x)
    first = lambda value, known, rest: T.bound(value, lambda x: F.when(x.isNotNull(), known(x)).otherwise(rest))

    def searched(page: Column) -> Column:
        by_isbn = first(F.coalesce(isbn(declared_isbn), stated_isbn(page)), as_isbn, of(none))
        return first(F.coalesce(doi(declared_doi), doi(page)), as_doi, first(jstor(page), as_jstor, by_isbn))

    return F.when(F.trim(edition_key) != "", of(edition_key)).otherwise(T.bound(page, searched))
