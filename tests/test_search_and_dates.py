import datetime
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import dates
from scriptorium.operators import search



def day(s):
    return datetime.date.fromisoformat(s) if s else None


PHRASES = [
    ("May 3d, 1862", "1862-05-03", "1862-05-03", "day"), ("yours of the 20th", "1862-02-20", "1862-02-20", "day"), ("19", "1862-02-19", "1862-02-19", "day"), ("15.", "1862-03-15", "1862-03-15", "day"),
    ("5.15.1862", "1862-05-15", "1862-05-15", "day"), ("winter of 1863", "1863-12-01", "1864-02-29", "season"), ("week of May 3, 1862", "1862-05-03", "1862-05-09", "week"), ("1860's", "1860-01-01", "1869-12-31", "decade"),
    ("Jany 5", "1862-01-05", "1862-01-05", "day"), ("5 December", "1861-12-05", "1861-12-05", "day"), ("letter of 29th ult.", None, None, None), ("to-day", "1862-03-15", "1862-03-15", "day"),
    ("Dated Sept. 1862", "1862-09-01", "1862-09-30", "month"), ("foo 1862", None, None, None), ("week of never", None, None, None), ("", None, None, None), (None, None, None, None),
]


def test_phrases_with_an_anchor(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHRASES)], "i int, p string")
    got = {r["i"]: r["d"] for r in rows.select("i", dates.parse(F.col("p"), F.lit("1862-03-15").cast("date")).alias("d")).collect()}
    for i, (phrase, start, end, precision) in enumerate(PHRASES):
        assert (got[i]["start"], got[i]["end"], got[i]["precision"]) == (day(start), day(end), precision), phrase


def test_no_anchor_refuses_what_needs_one(spark):
    rows = spark.createDataFrame([(p,) for p in ("15th ult.", "the 5th", "May 5", "5 May", "today", "yesterday")], "p string")
    assert {r["d"]["start"] for r in rows.select(dates.parse(F.col("p")).alias("d")).collect()} == {None}


def test_scanned_dates(spark):
    texts = [
        "Dee 5, 1862 and April 18/61. March 24 11 am 1862 Aug 9 [10] 1861", "in room 12 there were 1862 men", "Apr. 31 1862", None, "", "Marcli 3d 1863; 1860 1861 1862 1863 Xov. 2/64",
        "[May] 4 1862", "May 4/62",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: [(*x[:2], str(x[2])) for x in r["d"]] for r in rows.select("i", dates.scan("t").alias("d")).collect()}
    assert got[0] == [(0, 11, "1862-12-05"), (29, 48, "1862-03-24"), (49, 64, "1861-08-09")]
    assert got[5] == [(0, 14, "1863-03-03"), (36, 45, "1864-11-02")]
    assert got[6] == [(1, 12, "1862-05-04")]
    assert got[1] == got[2] == got[3] == got[4] == got[7] == []


def test_century_needs_years_of_one():
    assert dates.century_of(["1861", "1862", "1863", "1901"]) is None
    assert dates.century_of(["1861", "1862", "1863", "1901", "1902"]) == 1800
    assert dates.century_of(["1861", "1862", "1901", "1902", "1701", "1702"]) is None


def density(words, wanted):
    """Cover density by trying every stretch."""
    spots = [i for i, w in enumerate(words) if w in wanted]
    full = [(a, b) for a in spots for b in spots if a <= b and set(wanted) <= set(words[a : b + 1])]
    least = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
    return sum(search.WEIGHT / (1 + (b - a) - (sum(a <= s <= b for s in spots) - 1)) for a, b in least)


@pytest.mark.parametrize("wanted", [["a"], ["a", "b"], ["c", "A", "b", "a"], ["zz", "a"]])
def test_cover_density_is_that_of_every_stretch(spark, wanted):
    rng = random.Random(len(wanted))
    texts = [" ".join(rng.choices("abcdef", [1, 1, 1, 4, 4, 4], k=rng.randrange(0, 40))) for _ in range(60)] + [None, "?!"]
    docs = spark.createDataFrame([(i, t, ["en", "de-CH", None, "xx"][i % 4]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    index = search.inverted_index(docs, search.language_config(F.col("lang")))
    asked = list(dict.fromkeys(w.lower() for w in wanted))
    want = {i: density(t.split(), asked) for i, t in enumerate(texts) if t}
    for config, kept in ((None, range(len(texts))), ("german", range(1, len(texts), 4)), ("simple", [i for i in range(len(texts)) if i % 4 > 1])):
        best = sorted(((round(-want[i], 12), i) for i in kept if want.get(i)), key=tuple)[:10]
        got = search.cover_topk(index, wanted, 10, config).collect()
        assert [(r["doc_id"], round(r["score"], 9)) for r in got] == [(i, round(-s, 9)) for s, i in best]


def test_stored_index_and_bad_requests(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "b a a", "en"), (3, "a b", "de")], "doc_id long, text string, lang string")
    index = search.inverted_index(docs, search.language_config(F.col("lang")))
    search.write_index(index, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert search.cover_topk(stored, ["a", "b"], 5).collect() == search.cover_topk(index, ["a", "b"], 5).collect()
    few = spark.createDataFrame([(3,)], "doc_id long")
    assert [r["doc_id"] for r in search.cover_topk(stored, ["a"], 5, candidates=few).collect()] == [3]
    for bad in (lambda: search.cover_topk(stored, [], 5), lambda: search.cover_topk(stored, ["a"], 5, "klingon"), lambda: search.find(docs, docs, stored, [1.0], ["a"], 5, "magic")):
        with pytest.raises(ValueError):
            bad()


def test_find_by_mode_and_scorer(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(["a b", "b a a a", "c", "a"])], "doc_id long, text string, lang string, source string, n_chars int")
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [1.0, 0.1], [0.5, 0.5]])], "vec_id long, embedding array<double>")
    index = search.inverted_index(docs, search.language_config(F.col("lang")))
    ids = lambda df: [r["doc_id"] for r in df.orderBy(F.desc("score"), "doc_id").collect()]
    assert ids(search.find(docs, vectors, index, [1.0, 0.0], ["a"], 2, "vector")) == [0, 2]
    assert ids(search.find(docs, vectors, index, [1.0, 0.0], ["a"], 2, "keyword")) == [1, 0]
    assert ids(search.find(docs, vectors, index, [1.0, 0.0], ["a"], 9, "weighted", alpha=1.0))[:2] == [0, 2]
    assert set(ids(search.find(docs, vectors, index, [1.0, 0.0], ["a"], 9))) == {0, 1, 2, 3}
    assert ids(search.find(docs, vectors, index, [1.0, 0.0], ["a"], 2, candidates=docs.where("doc_id > 1").select("doc_id"))) == [3, 2]
    assert ids(search.find(docs, vectors, index, [1.0, 0.0], ["a"], 2, scorer=F.length("text"))) == [1, 0]


def test_quotes_that_name_their_document(spark):
    from scriptorium.operators import quotes

    long = "start alpha beta. " + "filler words here. " * 60 + "Alpha  beta gamma delta “quoted” of­fice end. " + "filler words here. " * 60 + "alpha beta gamma delta"
    far = long.index("Alpha  beta")
    docs = spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id long, text string")
    asked = [
        (1, "alpha beta", 1, None, None, ("exact", 6, 16, 1.0)), (2, "ALPHA BETA GAMMA", 1, None, None, ("normalized", far, far + 17, 1.0)), (3, "alpha beta gamma delta", 1, None, None, ("exact", len(long) - 22, len(long), 1.0)),
        (4, "alpha beta gamma delta", 1, far, far + 20, ("normalized", far, far + 23, 1.0)), (5, "start alpha", 1, far, far + 20, ("exact", 0, 11, 1.0)), (6, '"quoted" office', 1, far, far + 5, ("normalized", far + 24, far + 40, 1.0)),
        (7, "start alpha beta, or not", 1, None, None, ("near", 0, 16, 16 / 24)), (8, "zz", 1, 0, 5, ("not_found", None, None, 0.0)), (9, "x", 2, 0, 5, ("no_canonical_text", None, None, None)), (10, "x", 3, None, None, ("not_found", None, None, 0.0)),
        (11, "", 1, None, None, ("not_found", None, None, 0.0)), (12, None, 1, 0, 4, ("not_found", None, None, 0.0)), (13, "x", 99, None, None, ("no_canonical_text", None, None, None)),
    ]
    rows = spark.createDataFrame([r[:5] for r in asked], "quote_id long, quote string, doc_id long, window_start int, window_end int")
    got = {r["quote_id"]: r for r in quotes.verify_in_document(rows, docs).collect()}
    for quote_id, *_, want in asked:
        r = got[quote_id]
        assert (r["verdict"], r["char_start"], r["char_end"], r["share"]) == pytest.approx(want), quote_id
    assert got[7]["context"].startswith(". filler words")
    anywhere = spark.createDataFrame([(1, "BETA GAMMA DELTA"), (2, "start alpha beta, or not")], "quote_id long, quote string")
    assert {r["quote_id"]: (r["verdict"], r["char_start"]) for r in quotes.verify(anywhere, docs).collect()} == {1: ("normalized", far + 7), 2: ("near", 0)}


def test_surnames_and_directions(spark):
    from scriptorium.operators import works

    names = [("Stanton", "stanton"), ("Hon E M Stanton Secty of War", "stanton"), ("Genl. Edwin M. Stanton.", "stanton"), ("GBM to Lincoln", "lincoln"), ("you", None), ("Mr. X", None), ("the 42", None), ("", None), (None, None), ("Li", None)]
    got = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(names)], "i int, n string").select("i", works.surname(F.col("n")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: s for i, (_, s) in enumerate(names)}
    kinds = spark.createDataFrame([("enclosure",), ("received_letter",), ("else",), (None,)], "k string")
    assert [r[0] for r in kinds.select(works.letter_direction(F.col("k"))).collect()] == ["sent_by_author", "received_by_author", "unknown", "unknown"]


def test_chapters():
    from scriptorium.operators import chapters

    assert [chapters.chapter_number(t) for t in ("Seven", "XIV", "12", "TwentyFive", "xxvi", "zero")] == [7, 14, 12, 25, None, None]
    body = "y" * 6000 + "\n"
    contents = "Chapter 1\nChapter 2\nChapter 3\n"
    book = contents + "".join(f"Chapter {i}\n{body}" for i in (1, 2)) + "Chapter 1 and 2 above\n" + "".join(f"Chapter {i}\n{body}" for i in (3, 4))
    # The stray line begins an ascent of its own, 1, 3, 4, the only one of three lines a chapter apart.
    assert [(a, line) for a, _, line, _ in chapters.chapter_sections(book)] == [(30 + 2 * 6011, "Chapter 1 and 2 above"), (30 + 2 * 6011 + 22, "Chapter 3"), (30 + 3 * 6011 + 22, "Chapter 4")]
    whole = contents + "".join(f"Chapter {i}\n{body}" for i in (1, 2, 3, 4))
    assert [(book_line, whole[a : a + 9]) for a, _, book_line, _ in chapters.chapter_sections(whole)] == [(f"Chapter {i}", f"Chapter {i}") for i in (1, 2, 3, 4)]
    assert chapters.chapter_sections(whole + "z" * 40_000) == [] and chapters.chapter_sections("") == [] and chapters.chapter_sections(contents) == []
