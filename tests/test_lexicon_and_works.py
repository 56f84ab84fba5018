from pyspark.sql import functions as F

from scriptorium.operators import lexicon, works

U = "0000000%d-0000-4000-8000-000000000000"


def test_lemma_parts_and_filters(spark):
    got = spark.createDataFrame([("c/l/1234 a",), ("430",), ("l",)], "lemma string").select(lexicon.parse_lemma(F.col("lemma")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [("1234", "a", "c/l"), ("430", None, ""), (None, None, "")]
    words = spark.createDataFrame([(1, "he", "7", None, "Isa.63.19!b"), (2, "he", "7", "a", "Isa.1.1"), (3, "he", "7", "b", "Gen.2.4")], "word_id long, language string, strong string, homograph string, ref string")
    ids = lambda **k: sorted(r.word_id for r in lexicon.lemma_filter(words, "he", "7", **k).collect())
    assert (ids(), ids(homograph=""), ids(homograph="b"), ids(book="Isa", first=2)) == ([1, 2, 3], [1], [3], [1])
    refs = words.select(lexicon.ref_part(F.col("ref"), 3).alias("v"), lexicon.ref_part(F.col("ref"), 4).alias("half")).collect()
    assert [tuple(r) for r in refs] == [(19, "b"), (1, None), (4, None)]


def test_english_references_fold_halves(spark):
    hits = spark.createDataFrame([(1, "Isa.63.19"), (2, "Isa.1.1"), (3, "Gen.1.1"), (4, "Isa.8.23")], "word_id long, ref string")
    verse_map = spark.createDataFrame([("Isa.63.19", "a", "Isa.63.19", "partial"), ("Isa.63.19", "b", "Isa.64.1", "partial"), ("Isa.8.23", None, "Isa.9.1", "full")], "from_ref string, part string, to_ref string, kind string")
    folded = {r.word_id: (r.status, r.english) for r in lexicon.fold_halves(lexicon.english_reference(hits, verse_map).select("word_id", "ref", "english", "status"), "word_id").collect()}
    assert folded == {1: ("partial", "Isa.63.19; Isa.64.1"), 2: ("same", "Isa.1.1"), 3: ("unmapped", ""), 4: ("full", "Isa.9.1")}
    faults = lexicon.map_problems(verse_map.union(verse_map.limit(1).withColumn("to_ref", F.lit("X"))), spark.createDataFrame([("Isa.63.19",), ("Isa.64.1",), ("Isa.9.1",)], "ref string")).collect()
    assert {tuple(r) for r in faults} == {("several_targets", "Isa.63.19"), ("unknown_target", "X")}


def test_words_quote_their_text_and_caps(spark):
    texts = spark.createDataFrame([(1, "abc def")], "doc_id long, canonical string")
    words = spark.createDataFrame([(1, 1, "abc", 0, 3), (2, 1, "abc", 4, 7), (3, 1, "x", 6, 9), (4, 2, "x", 0, 1)], "word_id long, doc_id long, surface string, char_start long, char_end long")
    assert {r.word_id: r.fault for r in lexicon.misplaced_words(words, texts).collect()} == {2: "other_word", 3: "past_the_end", 4: "no_text"}
    assert lexicon.capped(words, 4).count() == 4 and lexicon.capped(words, 3).count() == 0


def test_blocks_markers_and_diffs(spark):
    blocks = spark.createDataFrame([("w", "a", None, 2, "x {{cite:%s}}" % (U % 1)), ("w", "b", None, 1, "{{cite:bad}}"), ("w", "c", "b", 1, "{{cite:%s}}" % (U % 2)), ("w", "lost", "none", 1, "")], "work string, key string, parent string, position int, body string")
    ordered = [r.key for r in works.block_order(blocks).orderBy("order").collect()]
    assert ordered == ["b", "c", "a"]
    cited = spark.createDataFrame([("w", "a", U % 1), ("w", "a", U % 3)], "work string, key string, citation string")
    assert {r["check"] for r in works.marker_checks(blocks, cited).collect()} == {"marker_invalid", "marker_dangling", "citation_unused"}
    new = blocks.where("key <> 'a'").withColumn("position", F.when(F.col("key") == "b", 9).otherwise(F.col("position")))
    assert {r.key: r.change for r in works.draft_diff(blocks, new).collect()} == {"a": "removed", "b": "changed", "c": "kept", "lost": "kept"}
    same = works.revision_hash(blocks.repartition(4)).first().content_hash
    assert same == works.revision_hash(blocks).first().content_hash != works.revision_hash(new).first().content_hash
    copied = {r.key: r for r in works.copy_forward(blocks, 2).collect()}
    assert copied["c"].parent_id == copied["b"].block_id


def test_extraction_records(spark):
    passages = spark.createDataFrame([(1, "Sent a letter to A."), (2, "none")], "passage_id long, text string")
    model = lambda texts: ['[{"record_type": "letter", "fields": "{\\"to\\": \\"A\\"}", "evidence": "letter to A"}]' if "letter" in t else "[]" for t in texts]
    done = spark.createDataFrame([(2, "ok"), (1, "failed")], "passage_id long, status string")
    made = works.extract(passages, model, done)
    checked = works.validated(works.records(made), passages, {"letter": ["to"]}).collect()
    assert [(r.passage_id, r.fault, r.evidence_start, r.evidence_end) for r in checked] == [(1, None, 7, 18)]


def test_date_anchor_takes_the_nearest(spark):
    passages = spark.createDataFrame([(1, 1, "r.n0.n1"), (2, 1, "r.n1"), (3, 1, None)], "passage_id long, doc_id long, path string")
    nodes = spark.createDataFrame([(1, "r.n0", "1862"), (1, "r.n0.n1", None), (1, "r.n1", "1870")], "doc_id long, path string, date string")
    docs = spark.createDataFrame([(1, "1850")], "doc_id long, date string")
    assert {r.passage_id: r.anchor for r in works.date_anchor(passages, nodes, docs).collect()} == {1: "1862", 2: "1870", 3: "1850"}
