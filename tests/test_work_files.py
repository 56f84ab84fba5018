"""Work files: headers and entries that can and can't be read, lists of files, years."""

import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import work_files
from scriptorium.sources import work_files as source

ENTRY = {"id": "c1", "intent": "support", "document_id": 5, "char_start": 0, "char_end": 4, "quoted_text": "text"}
HEAD = "work: w\ntitle: T\ntype: essay\nstatus: draft\ncreated: 2020-01-02\n"


def file(header: str, body: str = "body") -> bytes:
    return f"---\n{header}---\n{body}".encode()


@pytest.mark.parametrize(("data", "error"), [
    (b"no fence", "no front matter"), (b"---\nwork: w\n", "isn't closed"), (file("a: [\n"), "invalid YAML"), (file("- x\n"), "no mapping"), (file(HEAD + "extra: 1\n"), "unknown keys"), (file(HEAD.replace("essay", "poem")), "invalid type"),
    (file(HEAD.replace("draft", "done")), "invalid status"), (file(HEAD.replace("2020-01-02", "[1]")), "invalid created"), (file(HEAD + "citations: x\n"), "invalid citations"), (file(HEAD + "claims: [1]\n"), "invalid claims"), (file("work: w\n"), "invalid title"),
])
def test_bad_headers(data, error):
    with pytest.raises(ValueError, match=error):
        source.parse_work(data, "p")


def test_a_bad_entry_spoils_only_itself():
    entries = [ENTRY, ENTRY | {"id": "x1"}, ENTRY | {"char_end": 0}, ENTRY | {"char_start": -1}, ENTRY | {"quoted_text": " "}, ENTRY | {"intent": "joke"}, ENTRY | {"role": "asserts", "locator": {"page": 3}, "id": "c2"}, ENTRY | {"more": 1}, "text", ENTRY | {"role": "x"}, ENTRY | {"char_start": True}]
    lines = "".join(f"- {x!r}\n" if isinstance(x, str) else f"- {x}\n".replace("True", "true") for x in entries)
    work = source.parse_work(file(HEAD + "claims: [a, b]\ncitations:\n" + lines, "one [^c1] two[^c2][^c2]\n[^c3]: an old note [^c9]\nend"), "p")
    assert [c["id"] for c in work["citations"]] == ["c1", "c2"] and work["citations"][1]["locator"] == {"page": "3"} and work["citations"][0]["document_id"] == "5"
    assert [e["message"] for e in work["entry_errors"]] == [
        "invalid id", "invalid char_end", "invalid char_start", "invalid quoted_text", "invalid intent", "unknown fields ['more']", "no mapping: 'text'", "invalid role", "invalid char_start, char_end",
    ]
    assert work["markers"] == ["c1", "c2", "c2"] and work["claims"] == ["a", "b"] and work["created"] == datetime.date(2020, 1, 2)


def test_frames_and_lists(spark, tmp_path):
    for name in ("a.md", "sub/b.md", "README.md", "_TEMPLATE.md", "a (conflicted copy).md", "a.sync-conflict-1.md", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(file(HEAD) if name != "sub/b.md" else b"broken")
    works = source.read_works(source.list_works(spark, str(tmp_path)))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in works.collect()}
    assert set(rows) == {"a.md", "b.md"} and rows["a.md"].error is None and rows["b.md"].error == "no front matter" and rows["b.md"].citations is None
    documents = spark.createDataFrame([], "doc_id long, edition_key string, author string, title string, year string")
    empty = work_files.verify(works, documents, spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, char_start int, char_end int"), spark.createDataFrame([], "ref string"))
    assert empty.count() == 0 and [r.passed for r in work_files.gate(works, empty).collect()] == [True]


def test_footnotes_and_years(spark):
    for value, year in (("1862-03-04", "1862"), ("1862", "1862"), ("18621", "18621"), (" ", None), (None, None), ("c. 1862", "c. 1862")):
        assert spark.createDataFrame([(value,)], "x string").select(work_files.year_of(F.col("x")).alias("y")).first().y == year
    cited = ENTRY | {"edition": "2nd", "locator": {"volume": "II", "page": "7", "folio": "3r"}}
    more = ENTRY | {"id": "c10", "document_id": 6}
    data = file(HEAD + f"citations:\n- {more}\n- {cited}\n", "x[^c10] y[^c1]\n\n[^c1]: old\n")
    works = source.read_works(spark.createDataFrame([("p", bytearray(data))], "path string, content binary"))
    documents = spark.createDataFrame([(5, None, "A. Author", "Title", "1862-03-04")], "doc_id long, edition_key string, author string, title string, year string")
    texts = spark.createDataFrame([(5, "text here")], "doc_id long, text string")
    notes = work_files.footnotes(work_files.checked(works, documents, texts, spark.createDataFrame([], "doc_id long, char_start int, char_end int")), documents)
    assert work_files.rendered(works, notes).first().text == (
        "x[^c10] y[^c1]\n\n[^c1]: A. Author, *Title*, 2nd, vol. II (1862), p. 7, folio 3r. [exact]\n[^c10]: document 6, document 6. [no_canonical_text] [provisional]\n"
    )


def test_works_are_parsed_and_quotations_searched_once(spark):
    from scriptorium.plans import file_queries

    d = "/root/testdata/sf0.001"
    own = file_queries.works(spark, d)
    assert "MapInPandas" not in own._jdf.queryExecution().optimizedPlan().toString()
    plan = file_queries.findings(spark, d, own)._jdf.queryExecution().optimizedPlan().toString()
    assert "folded_hit" not in plan  # both readers of the findings read what is written
