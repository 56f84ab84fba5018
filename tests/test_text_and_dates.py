import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import dates, jsons
from scriptorium.functions import text as T


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("phrase", "start", "end", "precision"), [
    ("March 3, 1862", "1862-03-03", "1862-03-03", "day"), ("3rd of March 1862", "1862-03-03", "1862-03-03", "day"), ("about 1862", "1862-01-01", "1862-12-31", "year"),
    ("1862-03-03", "1862-03-03", "1862-03-03", "day"), ("3/4/1862", "1862-03-04", "1862-03-04", "day"), ("winter 1862", "1862-12-01", "1863-02-28", "season"),
    ("Feb. 1864", "1864-02-01", "1864-02-29", "month"), ("the 1860s", "1860-01-01", "1869-12-31", "decade"), ("April 31, 1862", None, None, None), ("no date", None, None, None),
])
def test_fuzzy_dates(spark, phrase, start, end, precision):
    got = one(spark, dates.parse(F.col("p")), p=phrase)
    day = lambda s: datetime.date.fromisoformat(s) if s else None
    assert (got["start"], got["end"], got["precision"]) == (day(start), day(end), precision)


@pytest.mark.parametrize(("phrase", "want"), [("today", "1862-03-15"), ("yesterday", "1862-03-14"), ("5th inst.", "1862-03-05"), ("30th ult.", None), ("2d prox", "1862-04-02"), ("31 prox", None), ("2 prox.", "1862-04-02")])
def test_anchored_dates(spark, phrase, want):
    got = one(spark, dates.anchored(F.col("p"), F.to_date(F.lit("1862-03-15"))), p=phrase)
    assert got == (datetime.date.fromisoformat(want) if want else None)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" abAB-\n\t “’­éﬁ—", max_size=30))
def test_fold_offsets_point_at_their_source(text):
    folded, starts = T.fold_with_offsets(text)
    assert len(folded) == len(starts) and starts == sorted(starts)
    assert folded == folded.strip() and "  " not in folded


def test_fold(spark):
    assert one(spark, T.fold(F.col("t")), t="  The “ﬁne” exam-\nple—x  y ") == 'the "fine" example-x y'
    assert one(spark, T.fold(F.col("t")), t=None) is None


def test_slices_and_locate(spark):
    assert one(spark, T.slice_span(F.col("t"), F.lit(-3), F.lit(2)), t="abcd") == "ab"
    assert one(spark, T.slice_span(F.col("t"), F.lit(2), F.lit(99)), t="abcd") == "cd"
    assert one(spark, T.locate0(F.col("t"), F.lit("c")), t="abcd") == 2
    assert one(spark, T.locate0(F.col("t"), F.lit("z")), t="abcd") is None


@pytest.mark.parametrize(("raw", "want"), [("0-306-40615-2", "9780306406157"), ("978-0-306-40615-7", "9780306406157"), ("9780306406158", None), ("080442957X", "9780804429573"), ("x", None)])
def test_isbn(spark, raw, want):
    assert one(spark, T.isbn13(F.col("t")), t=raw) == want


def test_doi_and_year(spark):
    assert one(spark, T.first_doi(F.col("t")), t="see https://doi.org/10.1000/ABC.12).") == "10.1000/abc.12"
    assert one(spark, T.year(F.col("t")), t="1862-3") == 1862 and one(spark, T.year(F.col("t")), t="18620") is None


def test_trigrams(spark):
    assert one(spark, T.trigram_similarity(T.trigrams(F.col("a")), T.trigrams(F.col("b"))), a="word", b="words") == pytest.approx(4 / 7)
    assert one(spark, T.trigram_similarity(T.trigrams(F.col("a")), T.trigrams(F.col("b"))), a="", b="--") == 0.0


@pytest.mark.parametrize(("data", "literal", "want"), [
    ('{"k": 1, "a": {"b": "x"}}', {"k": 1}, True), ('{"k": 1, "a": {"b": "x"}}', {"a": {"b": "x"}}, True), ('{"k": 1}', {"k": 2}, False), ('{"t": ["a", "b"]}', {"t": ["b"]}, True),
    ('{"t": ["a"]}', {"t": ["b"]}, False), ('{"t": "a"}', {"t": ["a"]}, False), ("nope", {"k": 1}, False), ('{"k": 1}', {}, True), (None, {"k": 1}, False),
])
def test_json_containment(spark, data, literal, want):
    assert one(spark, jsons.contains(F.col("j"), literal), j=data) is want


def test_tokens_by_script(spark):
    from scriptorium.functions import tokens as K

    def plain(text):
        sample = text[:: len(text) // 60_000 + 1] if len(text) > 60_000 else text
        cost = lambda c: 1 / (4 if c < 128 else next((r for a, b, r in K.SCRIPTS if a <= c <= b), 2))
        costs = [cost(ord(c)) for c in sample]
        return (len(sample) / sum(costs), 1 / max(costs)) if costs else (4, 4)

    texts = ["", "plain", "λόγος", "Ἐν ἀρχῇ ἦν ὁ λόγος and more", "בְּרֵאשִׁית", "日本語テキスト", "мир", "سلام", "Ţ ɏ ế é 🙂", "é" * 70_001 + "字" * 60_000, "퟿￿\U0010ffff"]
    for t in texts:
        assert (K.rate(t), K.densest(t)) == pytest.approx(plain(t))
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string").select("i", "t", K.rates(F.col("t")).alias("r")).select("i", "r.*", K.estimate(F.col("t"), F.col("r.rate")).alias("n")).collect()
    for r, t in zip(sorted(rows), [*texts, ""], strict=True):
        assert (r.rate, r.densest) == pytest.approx(plain(t)) and r.n == max(1, int(len(t) / r.rate))


def test_chunks_hold_as_many_tokens_in_every_script():
    from scriptorium.functions import tokens as K
    from scriptorium.operators import chunking

    greek = "λόγος ἐστὶν ἀρχὴ πάντων καὶ τέλος. Ἀλλὰ μή. " * 400
    mixed = "An English sentence of some length here. " * 300 + greek
    for text in (greek, mixed, "漢" * 9000, "a" * 9000):
        windows = chunking.prose_window(text)
        assert max(K.count(b - a, K.rate(text)) for a, b in windows) <= 575  # at the document's rate; a sentence counts whole tokens
        assert all(K.count(b - a, K.rate(text[a:b])) <= 2000 for a, b in chunking.whole_or_paragraph(text))
    assert {b - a for a, b in chunking.prose_window("漢" * 9000)} == {750} and {b - a for a, b in chunking.fixed_window("漢" * 7500)} == {750}
    # Latin windows: 2,000 characters a window, the last sentences of at most 50 tokens repeated.
    english = "".join(f"Sentence number {i:03d} is here. " for i in range(200))
    spans = chunking.prose_window(english)
    assert all(english[a:b].startswith("Sentence") and english[a:b].rstrip().endswith(".") for a, b in spans)
    assert all(0 < a[1] - b[0] <= 4 * 57 for a, b in zip(spans, spans[1:], strict=False))
    assert chunking.paragraphs("a\r\n\r\nb\n \n\nc") == [(0, 1), (5, 6), (10, 11)]


def test_windows_of_a_text(spark):
    rows = ["", "a", "abcdef", "abcdefg", "a😀b\nc😀😀d" * 5, None]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    for size, step in ((3, 3), (3, 2), (5, 1), (300, 300)):
        got = df.select("text", T.windows(F.col("text"), size, step).alias("w")).collect()
        assert {r.text: r.w for r in got} == {t: None if t is None else [t[i : i + size] for i in range(0, len(t), step)] for t in rows}


def test_folded_text_is_the_stepwise_fold():
    for raw in ["a-\r\n b", "a-\nB", "-\nb", "Der ﬁrst­  “Kuß”\u0085 x­y-\n\tz ", "  ", "", "İ　é 1-\n2", "a-\r\r\nb", "q--\nr"]:
        folded, starts = T.fold_with_offsets(raw)
        assert T.folded_text(raw) == folded
        assert [T.fold_with_offsets(raw, n)[1][:n] for n in range(1, len(folded) + 1)] == [starts[:n] for n in range(1, len(folded) + 1)]
