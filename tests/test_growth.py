"""Plans whose work must grow no faster than their input: what is shuffled, and what travels with it."""

from pyspark.sql import functions as F

from scriptorium.operators import catalog, reading, reindex, search


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "b a B"), (2, None), (3, ""), (4, "a")], "doc_id long, text string")
    index = search.inverted_index(docs)
    assert "Aggregate" not in plan(index)
    assert sorted(map(tuple, index.collect())) == [(1, "simple", "a", 1, [1]), (1, "simple", "b", 2, [0, 2]), (4, "simple", "a", 1, [0])]


def test_offsets_are_recovered_without_a_frame_a_document(spark):
    docs = spark.createDataFrame([(1, "ab ab"), (2, None)], "doc_id long, text string")
    passages = spark.createDataFrame([(10, 1, 0, "ab"), (11, 1, 1, "ab"), (12, 1, 2, "zz"), (20, 2, 0, "a"), (30, 3, 0, "a")], "passage_id long, doc_id long, position int, text string")
    found = reindex.recover_offsets(passages, docs)
    assert "CoGroup" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(10, 1, 0, 2), (11, 1, 3, 5), (12, 1, None, None), (20, 2, None, None), (30, 3, None, None)]


def test_spans_leave_their_text_before_they_are_looked_up(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, 1, 3), (1, 2, 9)], "doc_id long, start int, end int")
    found = catalog.resolve_spans(asked, asked.limit(0).withColumn("span_id", F.lit("x")).where("start > 99"), docs)
    assert [r.span_text for r in found.collect()] == ["bc"]
    known = asked.withColumn("span_id", F.concat_ws("-", "doc_id", "start"))
    shown = plan(catalog.resolve_spans(asked, known, docs))
    assert shown.index("LeftOuter") < shown.index("AS span_text")


def test_contexts_are_cut_after_the_last_join(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    anchors = spark.createDataFrame([(7, 1, 2, 3)], "anchor_id long, doc_id long, start int, end int")
    nodes = spark.createDataFrame([(1, "r", 0, 6, 0)], "doc_id long, path string, node_start int, node_end int, depth int")
    found = reading.anchor_contexts(anchors, docs, nodes, 1)
    assert [tuple(r) for r in found.collect()] == [(7, 1, 2, 3, "bcd", "r")]
    shown = plan(found)
    assert shown.index("AS context") < shown.index("Join")


def test_citations_are_joined_once_and_quotations_stay_where_they_are(spark):
    from scriptorium.operators import revisions
    from scriptorium.plans import work_queries

    r = work_queries.tables(spark, "/root/testdata/sf0.001")
    assert all("Join" not in plan(df) for df in (r.items, r.occurrences, r.spans, r.passages))
    assert "quoted_text" not in revisions.cited_items(r).columns


def test_rules_are_written_one_by_one_and_slices_change_nothing(spark, monkeypatch):
    from scriptorium.operators import revisions as R
    from tests.test_revisions import CLEAN, KEY, frames

    odd = [(n, f"b{n}", f"b{n + 1}", 1, "quotation", None, f"{{{{cite:{KEY(n)}}}}} {{{{cite:{KEY(3).upper()}}}}} {{{{cite:é {n}}}}}") for n in range(1, 6)]
    held = [(10 * n, n, f"b{n % 4}", KEY(n) if n < 4 else "é 4", "quotation") for n in range(1, 6)]
    r = frames(spark, blocks=odd, occurrences=held, items=[(10 * n, 0, 7, "e8", 100, "q" * 600, "near") for n in range(1, 6)], revisions=[(n, "essay", "essay", "frozen", "0") for n in range(1, 6)], texts=CLEAN["texts"])
    whole = R.validate(r)
    assert "Join" not in plan(whole)
    rows = lambda df: sorted(map(str, df.collect()))
    monkeypatch.setattr(R, "SLICE_ROWS", 1)
    assert R.slice_count(r.occurrences) == 5 and rows(R.validate(r)) == rows(whole)


def test_packed_keys_keep_their_text(spark):
    from scriptorium.operators import revisions as R

    keys = ["00000000-0000-4000-8000-00000000abcd", "00000000-0000-4000-8000-00000000ABCD", "", "é", "x" * 16, "000000000000-4000-8000-00000000abcd--", None]
    found = spark.createDataFrame([(k,) for k in keys], "k string").select("k", R.packed("k").alias("p")).select("k", F.length("p").alias("n"), R.unpacked("p").alias("back")).collect()
    assert [x.back for x in found] == keys and found[0].n == 17


def test_a_policy_joins_only_findings_that_it_names(spark):
    from scriptorium.operators import revisions as R

    revisions = spark.createDataFrame([(1, "essay"), (2, "note")], "revision_id long, work_type string")
    found = spark.createDataFrame([("AUTH_SPAN_REGION", 1), ("AUTH_SPAN_REGION", 2), ("AUTH_SPAN_REGION", 3), ("AUTH_UNUSED_CITATION", 1), ("OTHER", 1)], "rule string, revision_id long")
    moved = R.with_severity(found, revisions, {"essay": {"AUTH_SPAN_REGION": "allow"}})
    assert sorted((x.rule, x.revision_id, x.severity) for x in moved.collect()) == [("AUTH_SPAN_REGION", 2, "warning"), ("AUTH_SPAN_REGION", 3, "warning"), ("AUTH_UNUSED_CITATION", 1, "warning")]
    assert "Join" not in plan(R.with_severity(found, revisions))


def test_subjects_travel_only_with_rules_waived_by_subject(spark):
    from scriptorium.operators import revisions as R

    revisions = spark.createDataFrame([(1,), (2,)], "revision_id long")
    found = spark.createDataFrame([(1, rule, f"b{n}", None, "error") for rule in ("AUTH_DOCUMENT_UNKNOWN", "AUTH_QUOTE_UNVERIFIED") for n in range(3)], "revision_id long, rule string, block_key string, citation_key string, severity string")
    waivers = spark.createDataFrame([(1, "AUTH_QUOTE_UNVERIFIED", "b0"), (2, "AUTH_DOCUMENT_UNKNOWN", None)], "revision_id long, rule string, subject string")
    judged = R.gate(found, revisions, waivers)
    assert plan(judged).count("AUTH_QUOTE_UNVERIFIED") and "about" in plan(judged)
    assert {x.revision_id: x.blockers for x in judged.collect()} == {1: ["AUTH_DOCUMENT_UNKNOWN", "AUTH_QUOTE_UNVERIFIED"], 2: []}
    every = waivers.unionByName(spark.createDataFrame([(1, "AUTH_QUOTE_UNVERIFIED", f"b{n}") for n in (1, 2)] + [(1, "AUTH_DOCUMENT_UNKNOWN", None)], waivers.schema))
    assert {x.revision_id: x.passed for x in R.gate(found, revisions, every).collect()} == {1: True, 2: True}
