import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import aggregates, checks, chunking, quotes, relations, search, spans, works
from scriptorium.sources import files
from scriptorium.streaming import events as streams

TEXTS = ["", "  \n ", "One sentence.", "First one. Second one! Third? " * 200, "A\n\nB\n\n\nC  ", "字" * 5000, "x" * 30000, "# Head\n\nIntro.\n\n## Sub\n\nBody. " + "More text here. " * 400, "a\r\n\r\nb", "é" * 10]


@pytest.mark.parametrize("name", list(chunking.CHUNKERS))
def test_chunkers_quote_their_text(name):
    rng = random.Random(20260810)
    texts = TEXTS + ["".join(rng.choice("ab. \n#AB!") for _ in range(rng.randint(0, 6000))) for _ in range(20)]
    for text in texts:
        last = -1
        for a, b in chunking.CHUNKERS[name](text):
            assert 0 <= a < b <= len(text) and text[a:b].strip() and a > last
            # Windows of sentences and pieces of long ones keep the white space at their ends.
            assert name != "fixed_window" or text[a:b] == text[a:b].strip()
            assert b - a <= 8000
            last = a
        covered = set().union(*[range(a, b) for a, b in chunking.CHUNKERS[name](text)] or [set()])
        assert all(text[i].isspace() or i in covered for i in range(len(text)))


def test_chunk_frame(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in chunking.chunk(docs, "structural").collect():
        assert TEXTS[r.doc_id][r.char_start : r.char_end] == r.text
    nodes = docs.where("doc_id = 7").select(F.explode(chunking.node_tree("text")).alias("n")).select("n.*").collect()
    assert [n.path for n in nodes] == ["r", "r.n0", "r.n0.n0"] and nodes[1].char_end >= nodes[2].char_end


def test_span_joins_against_loops(spark):
    rng = random.Random(1)
    make = lambda n: [(i, i % 3, a, a + rng.randint(1, 900)) for i in range(n) for a in [rng.randint(0, 3000)]]
    left, right = make(60), make(80)
    lf = spark.createDataFrame(left, "l_id long, doc_id long, l_start long, l_end long")
    rf = spark.createDataFrame(right, "r_id long, doc_id long, r_start long, r_end long")
    want = {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and a[3] > b[2]}
    got = [(r.l_id, r.r_id) for r in spans.overlap_join(lf, rf, 256).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    inside = {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and b[2] <= a[2] and a[3] <= b[3]}
    assert {(r.l_id, r.r_id) for r in spans.containment_join(lf, rf, 256).collect()} == inside


def test_quotes(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox\njumps over the lazy dog near the river bank."), (2, "Another “quoted” text with an exam-\nple inside."), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "quick brown fox"), (2, "QUICK  brown fox jumps"), (3, 'another "quoted" text with an example'), (4, "jumps over the lazy dog near a castle"), (5, "nothing like it anywhere")], "quote_id long, quote string")
    got = {r.quote_id: (r.verdict, r.doc_id) for r in quotes.verify(asked, docs).collect()}
    assert got == {1: ("exact", 1), 2: ("normalized", 1), 3: ("normalized", 2), 4: ("near", 1), 5: ("not_found", None)}
    named = asked.select("quote_id", "quote", F.when(F.col("quote_id") == 5, 3).otherwise(1).cast("long").alias("doc_id"))
    assert {r.quote_id: r.verdict for r in quotes.verify_in_document(named, docs).collect()}[5] == "no_canonical_text"


def test_quotes_meet_every_document_that_may_hold_them(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the river bank."), (2, "Other words. §§ 12-14"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame(
        [(1, "brown fox jumps over the lazy dog, unquestionably"), (2, "rown fo"), (3, "ROWN FO"), (4, "§§"), (5, "ick"), (6, "lazy cat"), (7, "lazy dots"), (8, None), (9, "zebra"), (10, " ")], "quote_id long, quote string"
    )
    want = {1: ("near", 1), 2: ("exact", 1), 3: ("normalized", 1), 4: ("exact", 2), 5: ("exact", 1), 6: ("near", 1), 7: ("near", 1), 8: ("not_found", None), 9: ("not_found", None), 10: ("not_found", None)}
    for block, literal in ((10_000, 1000), (2, 0)):
        monkeypatch.setattr(quotes, "UNPROBED_BLOCK", block)
        monkeypatch.setattr(quotes, "LITERAL_PROBES", literal)
        assert {r.quote_id: (r.verdict, r.doc_id) for r in quotes.verify(asked, docs).collect()} == want
        assert {r.quote_id: r.doc_id for r in quotes.exact(asked, docs).collect()} == {2: 1, 4: 2, 5: 1, 10: 1}


def test_fusion_ties_and_empty_lists(spark):
    a = spark.createDataFrame([("p1", 0.95), ("p2", 0.8), ("p3", 0.6)], "id string, score double")
    b = spark.createDataFrame([("p1", 0.9), ("p3", 0.85), ("p2", 0.4)], "id string, score double")
    fused = [(r.id, r.score) for r in search.rrf([a, b], 10).collect()]
    assert fused[0] == ("p1", pytest.approx(2 / 61)) and {x for x, _ in fused} == {"p1", "p2", "p3"}
    assert search.rrf([a.limit(0), a], 10).count() == 3
    same = a.withColumn("score", F.lit(0.5))
    assert {r.score for r in search.weighted_fusion(same, b.limit(0), 0.5, 10).collect()} == {0.0}


def test_filters_and_upserts(spark):
    with pytest.raises(ValueError, match="unknown filter"):
        relations.validate_filters({"nope": 1})
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, seq int, v string")
    assert {(r.k, r.v) for r in relations.latest_wins(rows, ["k"], ["seq"]).collect()} == {("a", "y"), ("b", None)}
    assert {(r.k, r.v) for r in relations.keep_first(rows, ["k"], ["seq"]).collect()} == {("a", "x"), ("b", None)}
    assert relations.same_rows(rows, rows).count() == 0 and relations.same_rows(rows, rows.limit(2)).count() == 1


def test_policy_and_waivers(spark):
    found = spark.createDataFrame([("r1", "a", ""), ("r2", "b", ""), ("r3", "c", "")], "check string, id string, detail string")
    graded = checks.severities(found, {"r1": "allow", "r2": "warning"})
    assert {(r.check, r.severity) for r in graded.collect()} == {("r2", "warning"), ("r3", "error")}
    waived = spark.createDataFrame([("r3", None)], "check string, subject string")
    assert checks.blockers(graded, waived).count() == 0


def test_retrieval_metrics(spark):
    runs = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2), ("a", 2, "z", 1)], "run string, query int, id string, rank int")
    judged = spark.createDataFrame([(1, "y", 1.0), (1, "w", 1.0)], "query int, id string, gain double")
    got = {r.query: r for r in aggregates.retrieval_metrics(runs, judged, 2).collect()}
    assert (got[1].recall, got[1].precision, got[1].rr) == (0.5, 0.5, 0.5) and got[2].recall == 1.0


TEI = b"""<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>T</title></teiHeader><text><body><div><head>One</head><p>alpha</p><div><head>In</head><p>beta</p></div></div></body></text></TEI>"""


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("\nTitle line\nbody")
    (tmp_path / "copy.txt").write_text("\nTitle line\nbody")
    (tmp_path / "b.md").write_text("# Head\n\n**bold** and [link](u)\n\n## Next\n\ntext")
    (tmp_path / "sub" / "c.html").write_text("<html lang='en'><title>P</title><body><h1>H</h1><p>one &amp; two</p><script>x</script><h2>I</h2><p>three</p></body></html>")
    (tmp_path / "d.xml").write_bytes(TEI)
    (tmp_path / "bad.tei").write_bytes(b"<TEI>")
    (tmp_path / ".hidden.txt").write_text("no")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='o/p.opf'/></rootfiles></container>")
        z.writestr("o/p.opf", "<package><metadata><title>B</title></metadata><manifest><item id='x' href='x.html'/><item id='n' href='n.html' properties='nav'/></manifest><spine><itemref idref='n'/><itemref idref='x'/></spine></package>")
        z.writestr("o/x.html", "<h1>Ch</h1><p>words</p>")
        z.writestr("o/n.html", "<p>toc</p>")
    (tmp_path / "e.epub").write_bytes(book.getvalue())
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.parse(files.scan(spark, str(tmp_path))).collect()}
    assert rows["a.txt"].title == "Title line" and rows["b.md"].text.startswith("# Head\n\nbold and link")
    html = rows["c.html"]
    assert html.text == "H\none & two\nI\nthree" and [html.text[s.char_start : s.char_end].split("\n")[0] for s in html.sections] == ["H", "I"]
    assert rows["d.xml"].title == "T" and {s.heading for s in rows["d.xml"].sections} == {"One", "In"}
    assert rows["bad.tei"].error and rows["e.epub"].text == "Ch\nwords" and ".hidden.txt" not in rows
    store = files.ingest(spark, str(tmp_path)).select("content_hash", "source")
    assert store.count() == 6 and files.ingest(spark, str(tmp_path), store).count() == 0


def test_streams(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    base.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), base, 1)
    seen = []
    q = streams.run_available(streams.windowed_counts(stream, "1 hour", late="60 days"), str(tmp_path / "ck"), lambda df, n: seen.extend(df.collect()), "update")
    q.awaitTermination()
    latest = {(r.window_start, r.event_type): r.n for r in seen}
    assert sum(latest.values()) == base.count()


def test_quotes_cut_inside_words_of_marks_and_ligatures(spark):
    docs = spark.createDataFrame([(1, "Running theatres are warm."), (2, "What ... ?! he said"), (3, "The oﬃce is open"), (4, "plain")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "ing theat"), (2, "... ?!"), (3, "unnin"), (4, "the office is"), (5, "FFICE IS O"), (6, "nothing of this")], "quote_id long, quote string")
    got = {r.quote_id: (r.verdict, r.doc_id) for r in quotes.verify(asked, docs).collect()}
    assert got == {1: ("exact", 1), 2: ("exact", 2), 3: ("exact", 1), 4: ("normalized", 3), 5: ("normalized", 3), 6: ("not_found", None)}
    assert {r.quote_id: r.doc_id for r in quotes.exact(asked, docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_block_order_of_a_deep_chain(spark):
    rows = [(1, f"k{i}", f"k{i - 1}" if i else None, 10_000_000 + i) for i in range(40)] + [(1, "x", "k0", 9_000_000), (1, "y", "gone", 1), (2, "a", "b", 1), (2, "b", "a", 1)]
    got = sorted((r.order, r.key) for r in works.block_order(spark.createDataFrame(rows, "work int, key string, parent string, position long")).collect())
    assert [k for _, k in got] == ["k0", "x", *[f"k{i}" for i in range(1, 40)]]


def test_tei_keeps_lead_texts_tails_and_items_apart():
    data = b"<TEI><text><body><div>lead<head>One</head><p>al<hi>ph</hi>a</p>tail<list><item>first</item><item>second</item></list><div><p>in</p></div>after</div></body></text></TEI>"
    parsed = files.parse_tei(data, "x")
    text = parsed["text"]
    assert text == "lead\nOne\nal ph a\ntail\nfirst second\nin\nafter"
    assert [(text[s["char_start"] : s["char_end"]], s["heading"], s["level"]) for s in parsed["sections"]] == [("lead\nOne\nal ph a\ntail\nfirst second", "One", 1), ("in", "", 2), ("after", "", 1)]


def test_retyped_quotes_are_never_exact(spark):
    docs = spark.createDataFrame([(1, "Then a quiet harbour town slept."), (2, "THEN A QUIET HARBOUR TOWN SLEPT.")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "A QUIET HARBOUR TOWN")], "quote_id long, quote string")
    verdicts = lambda **how: [tuple(r) for r in quotes.verify(asked, docs, **how).collect()]
    assert verdicts() == [(7, "exact", 2, 5)]
    assert verdicts(verbatim=False) == [(7, "normalized", 1, 5)]
