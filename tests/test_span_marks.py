"""Spans travel without the long texts they quote, and are held against them all the same."""

from scriptorium.operators import diagnostics


def test_long_quotes_stay_where_they_are(spark):
    text = "é" + "abcdefghij" * 30
    texts = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = [(1, 1, 0, 200, text[:200]), (2, 1, 0, 200, text[1:201]), (3, 1, 5, 9, text[5:9]), (4, 1, 5, 9, "zzzz"), (5, 1, 0, 63, text[:63]), (6, 1, 0, 62, text[:62]), (7, 1, 0, 5, None), (8, 1, 0, 999, text)]
    passages = spark.createDataFrame(rows, "passage_id long, doc_id long, char_start int, char_end int, text string")
    found = diagnostics.span_faults(diagnostics.Corpus(passages, texts.select("doc_id"), texts))
    assert "sha2" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("passage_span_within_the_text", "8"), *[("passage_text_matches_its_span", i) for i in "247"]]
