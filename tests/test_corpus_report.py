"""The corpus report: each invariant finds what breaks it, and nothing else."""

from scriptorium.operators import diagnostics
from scriptorium.plans import corpus_queries

PASSAGE = "passage_id long, doc_id long, char_start int, char_end int, text string, node_id long, chunker string, chunker_version string"


def corpus(spark, passages, texts, **more):
    documents = spark.createDataFrame([(1, "/a"), (2, "C:x"), (3, "http://h"), (4, "rel/path")], "doc_id long, source string")
    return diagnostics.Corpus(spark.createDataFrame(passages, PASSAGE), documents, spark.createDataFrame(texts, "doc_id long, text string"), **more)


def test_every_check_has_its_offenders(spark):
    rows = diagnostics.report(corpus_queries.corpus(spark, "/root/testdata/sf0.01"), corpus_queries.VERSIONS).collect()
    assert {r.check for r in rows} == set(diagnostics.CHECKS) and all(r.n > 0 and not r.skipped for r in rows)


def test_planted_defects(spark):
    good = (1, 1, 0, 5, "Grüße", 1, "c", "2")
    passages = [
        good, (2, 1, 6, 3, "", 1, "c", "2"), (3, 1, None, None, "x", 1, "c", "1"), (4, 4, None, 5, "x", None, None, None), (5, 3, 0, None, "x", None, "d", "1"), (6, 2, 0, 1, "  ", None, "c", "2"),
        (7, 1, 0, 99, "Grüße", 1, "c", "2"), (8, 1, -1, 5, "Grüße", 1, "c", "2"), (9, 1, 0, 5, "Gruße", 2, "c", "2"), (10, 1, 7, 11, "Welt", 1, "c", "1"), (11, 1, 0, 5, "漢" * 1000, 1, "c", "2"), (12, 1, 0, 5, "漢" * 1000, 1, "c", None),
    ]
    found = {(r.check, r.id) for r in diagnostics.offenders(corpus(spark, passages, [(1, "Grüße, Welt"), (2, None)]), {"c": "2"}).collect()}
    assert found == {
        ("passage_span_well_formed", "2"), ("passage_has_offsets", "3"), ("passage_offsets_recoverable_by_reparse", "4"), ("passage_offsets_need_a_pack_reingest", "5"), ("document_has_canonical_text", "4"),
        ("document_text_needs_a_pack_reingest", "2"), ("document_text_needs_a_pack_reingest", "3"), ("passage_is_not_empty", "2"), ("passage_is_not_empty", "6"), ("passage_span_within_the_text", "7"),
        ("passage_span_within_the_text", "8"), ("passage_text_matches_its_span", "9"), ("passage_text_matches_its_span", "11"), ("passage_text_matches_its_span", "12"), ("passages_on_current_chunker_versions", "3"),
        ("passages_on_current_chunker_versions", "10"), ("passages_on_current_chunker_versions", "12"), ("current_chunkers_are_not_emitting_oversized_passages", "c 2: 1000 chars"), ("passage_is_not_oversized", "12"),
    }


def test_a_check_without_its_table_is_skipped(spark):
    rows = {r.check: r for r in diagnostics.report(corpus(spark, [(1, 1, 0, 2, "ab", 1, "c", "2")], [(1, "ab")]), {}).collect()}
    skipped = {name for name, r in rows.items() if r.skipped}
    assert len(skipped) == 10 and all(rows[x].severity == "info" for x in skipped) and all(r.n == 0 for r in rows.values())
    nothing = diagnostics.report(corpus(spark, [], []), {"c": "2"}).collect()
    assert len(nothing) == 22 and all(r.n == 0 for r in nothing)
