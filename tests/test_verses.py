"""Verse layouts: chapters are read whole or refused; coverage, locators, maps."""

import pytest

from scriptorium.operators import verses as V

N = "\xa0"


def seen(text, regions):
    return [(r.kind, r.number, text[r.start : r.end]) for r in regions]


def running(*blocks, chapter=3):
    text = V.SEPARATOR.join(blocks)
    regions = V.running(text, chapter)
    return None if regions is None else (seen(text, regions), V.unclaimed(text, regions, V.GAPS["running"]))


def test_labelled():
    text = V.SEPARATOR.join(["3 1 \tFirst verse. ", "2 \tSecond,\n\nwith a blank line ", "3 \t "])
    regions = V.labelled(text, 3)
    assert seen(text, regions) == [("verse", 1, "First verse."), ("verse", 2, "Second,\n\nwith a blank line"), ("verse", 3, "")]
    assert V.unclaimed(text, regions, V.GAPS["labelled"]) == []
    assert V.unclaimed(text, regions[:1] + regions[2:], V.GAPS["labelled"]) == [text[regions[0].end : regions[2].start][:60]]
    assert V.unclaimed(text, [*regions, regions[0]], V.GAPS["labelled"]) == [f"overlap at {regions[0].start}"]
    assert [r.number for r in V.labelled("1 \tA book of one chapter ", 1)] == [1]
    assert V.labelled("no label", 3) is None and V.labelled("4 1 \tanother chapter's", 3) is None and V.labelled("", 3) is None


def test_unmarked():
    text = "\n\n First. \n\n\n\nSecond\nline\n\n"
    assert seen(text, V.unmarked(text)) == [("verse", 1, "First."), ("verse", 2, "Second\nline")] and V.unclaimed(text, V.unmarked(text), V.GAPS["unmarked"]) == []
    assert V.unmarked("") == []


def test_running_verses_and_headings():
    got, faults = running("The Fall", f"3{N}Now the serpent. 2{N}And she said,", f"\t3{N}\tBut God said.", "The Curse", f"4{N}To the man.")
    assert got == [("heading", None, "The Fall"), ("verse", 1, "Now the serpent."), ("verse", 2, "And she said,"), ("verse", 3, "But God said."), ("heading", None, "The Curse"), ("verse", 4, "To the man.")] and faults == []
    # A line of verse that looks like a title stays in its verse: what follows goes on in lower case, or has no number, or the line is closed, indented or numbered.
    for line, after in (("Against whom", f"and you. 2{N}Next."), ("A Title", "More text."), ("A title,", f"2{N}Next."), ("\tA Title", f"2{N}Next."), ("a title", f"2{N}Next."), ("A title;6", f"2{N}Next.")):
        got, faults = running(f"3{N}Begin", line, after)
        assert got[0][:2] == ("verse", 1) and line.strip() in got[0][2] and all(k != "heading" for k, _, _ in got) and faults == []
    # Footnote numerals aren't numbers of verses.
    assert [x[1] for x in running(f"3{N}the waters.1 And 2{N}there was")[0]] == [1, 2]


def test_running_psalm_foreign_and_refusals():
    got, faults = running(f"3{N}A Psalm of David.", f"1{N}O Lord, 2{N}many say")
    assert got == [("superscription", None, "A Psalm of David."), ("verse", 1, "O Lord,"), ("verse", 2, "many say")] and faults == []
    got, faults = running(f"8{N}[[53{N}They went home, 1{N}but Jesus went. 2{N}Early.]]", chapter=8)
    assert got == [("bracket", None, "[["), ("foreign_verse", 53, "They went home,"), ("verse", 1, "but Jesus went."), ("verse", 2, "Early.]]")]
    for text in ("no numbers", f"4{N}another chapter", f"3{N}one 2{N}two 2{N}two again", f"3{N}one 5{N}five 4{N}four"):
        assert V.running(text, 3) is None
    assert [n for _, n, _ in running(f"3{N}one 2{N}two 4{N}a number may be missing")[0]] == [1, 2, 4]


@pytest.mark.parametrize("layout", list(V.LAYOUTS))
def test_frames(spark, layout):
    texts = {1: "3 1 \tab ", 2: f"3{N}One. 2{N}Two.", 3: "plain", 4: "", 5: None}
    frame = spark.createDataFrame([(i, 3, t) for i, t in texts.items()] + [(6, None, "x")], "doc_id long, chapter int, text string")
    read = {r.doc_id: r for r in V.read_chapters(frame, layout).collect()}
    for i, t in texts.items():
        own = None if t is None else V.LAYOUTS[layout](t, 3)
        good = own is not None and not V.unclaimed(t, own, V.GAPS[layout])
        assert bool(read[i].faults) != good and [tuple(r) for r in read[i].regions] == ([tuple(r) for r in own] if good else [])
    assert read[6].faults and V.regions(V.read_chapters(frame, layout)).count() == sum(len(r.regions) for r in read.values())


def test_passages_words_and_maps(spark):
    texts = spark.createDataFrame([(1, "אב גד  הו")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 3, "verse", 1, 0, 2, None), (1, 3, "verse", 2, 3, 7, None), (1, 3, "heading", None, 7, 9, "x")], "doc_id long, chapter int, kind string, number int, char_start int, char_end int, title string")
    passages = spark.createDataFrame([(10, 1, 0, 3), (11, 1, 5, 9), (12, 1, 1, 4), (13, 1, 2, 3)], "passage_id long, doc_id long, char_start int, char_end int")
    got = {r.passage_id: r.locator for r in V.locators(V.verses_of(passages, found, texts), V.F.lit("Gen"), V.F.lit(3)).collect()}
    assert got == {10: "Gen 3:1", 12: "Gen 3:1-2"}
    words = spark.createDataFrame([(1, 0, 2), (1, 1, 2)], "doc_id long, char_start int, char_end int")
    marks = spark.createDataFrame([(1, 3, 5)], "doc_id long, char_start int, char_end int")
    assert [(r.char_start, r.gap) for r in V.unclaimed_letters(words, texts, marks).collect()] == [(5, "  הו")]
    assert V.unclaimed_letters(words.union(marks), texts.where("false")).count() == 0
    xml = b'<m xmlns="urn:x"><book><verse wlc="Isa.63.19!b" kjv="Isa.64.1" type="partial"/><verse wlc="Gen.32.1" kjv="Gen.31.55"/></book></m>'
    rows = V.verse_map(spark.createDataFrame([(bytearray(xml),)], "content binary")).collect()
    assert [tuple(r) for r in rows] == [("Isa.63.19", "b", "Isa.64.1", None, "partial"), ("Gen.32.1", None, "Gen.31.55", None, "full")]
