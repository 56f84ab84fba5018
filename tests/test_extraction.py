"""Extraction schemas, records held to them, and identities of editions."""

import json
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import identifiers as I
from scriptorium.operators import extraction as X

DEFINITION = {
    "record_types": [
        {"id": "claim", "fields": {"who": {"type": "entity_ref", "required": True}, "quote": {"type": "evidence_span", "required": True}, "kind": {"type": "enum", "values": ["a", "b"]}}},
        {"id": "event", "fields": {"when": {"type": "fuzzy_date", "description": "The day."}, "size": {"type": "number", "range": [0, 9]}, "tags": {"type": "array", "required": True}, "kind": {"type": "enum", "values": ["b", "c"]}, "quote": {"type": "evidence_span"}, "also": {"type": "evidence_span"}}},
    ]
}
PROMPT = "Read {{ passage_text }}."


def test_output_schema():
    record = X.output_schema(DEFINITION)["properties"]["records"]["items"]["properties"]
    assert record["record_type"]["enum"] == ["claim", "event"] and set(record["fields"]["properties"]) == {"who", "quote", "kind", "when", "size", "tags", "also"}
    fields = record["fields"]["properties"]
    assert fields["kind"]["enum"] == ["a", "b", "c"] and fields["tags"]["items"] == {"type": "string"} and (fields["size"]["minimum"], fields["size"]["maximum"]) == (0, 9)
    assert fields["when"]["type"] == "string" and fields["when"]["description"].startswith("The day. Give") and "identifier" in fields["who"]["description"]


@pytest.mark.parametrize(("definition", "prompt", "fault"), [
    (DEFINITION, PROMPT, None), ({}, PROMPT, "needs a record type"), ({"record_types": [{"fields": {}}]}, PROMPT, "no id"), ({"record_types": [{"id": "a"}, {"id": "a"}]}, PROMPT, "twice"), ({"record_types": [{"id": "a"}]}, PROMPT, "no fields"),
    ({"record_types": [{"id": "a", "fields": {"x": {}}}]}, PROMPT, "evidence_span"), (DEFINITION, "Read it.", "prompt"),
    ({"record_types": [{"id": "a", "fields": {"x": {"type": "evidence_span"}}}, {"id": "b", "fields": {"x": {"type": "number"}}}]}, PROMPT, "another type"),
])
def test_definitions(definition, prompt, fault):
    got = X.definition_fault(definition, prompt)
    assert got is None if fault is None else fault in got


def plain(kinds, kind, text, passage):
    """(fault, span) of one record."""
    if kind not in kinds:
        return "unknown record type", None
    try:
        fields = json.loads(text)
    except (TypeError, ValueError):
        fields = None
    if not isinstance(fields, dict):
        return "no fields", None
    for name, spec in kinds[kind].items():
        if spec.get("required") and not fields.get(name):
            return f"missing {name}", None
    spans = []
    for name, spec in kinds[kind].items():
        value = fields.get(name)
        if spec.get("type") != X.EVIDENCE or value is None:
            continue
        if not isinstance(value, str):
            return f"{name} is no quotation", None
        words = value.split()
        found = (re.search(re.escape(value), passage) or re.search(r"\s+".join(map(re.escape, words)), passage)) if words else None
        if not found:
            return f"{name} is not in the passage", None
        spans.append(found.span())
    return (None, spans[0]) if spans else ("quotes nothing", None)


def test_records_against_a_plain_reading(spark):
    passage = "🙂 One (two)\n three.  Four \\Efive\\Q six; one two three."
    records = [
        ("claim", {"who": "A", "quote": "One (two) three."}), ("claim", {"who": "A", "quote": "two)\n three"}), ("claim", {"who": "", "quote": "One"}), ("claim", {"who": None, "quote": "One"}), ("claim", {"quote": "One"}), ("claim", {"who": 0, "quote": "One"}), ("claim", {"who": "0", "quote": "six;  one"}),
        ("claim", {"who": "A", "quote": ["One"]}), ("claim", {"who": "A", "quote": " Four \\Efive\\Q  six "}), ("claim", {"who": "A", "quote": "five"}), ("claim", {"who": "A", "quote": "absent"}), ("claim", {"who": "A", "quote": "one.two"}), ("event", {"tags": [], "quote": "One"}), ("event", {"tags": ["x"]}),
        ("event", {"tags": ["x"], "quote": None, "also": "six"}), ("event", {"tags": ["x"], "quote": "six", "also": "nowhere"}), ("event", {"tags": {"a": 1}, "quote": "six", "also": ""}), ("event", {"tags": ["x"], "quote": 5}), ("event", {"tags": False, "quote": "six"}), ("other", {}), (None, {}),
    ]
    rows = [(i, 1, 0, kind, json.dumps(fields, ensure_ascii=False)) for i, (kind, fields) in enumerate(records)] + [(90, 1, 0, "claim", "[1]"), (91, 1, 0, "claim", "broken"), (92, 1, 0, "claim", None), (93, 1, 1, "claim", '{"who": "A", "quote": "six"}')]
    kinds = X.record_types(DEFINITION)
    frame = spark.createDataFrame(rows, "extraction_id long, passage_id long, n int, record_type string, fields string")
    found = X.anchored(frame, spark.createDataFrame([(1, passage)], "passage_id long, text string"), kinds)
    got = {r.extraction_id: (r.fault, None if r.evidence_start is None else (r.evidence_start, r.evidence_end)) for r in found.collect()}
    assert got == {r[0]: plain(kinds, r[3], r[4], passage) for r in rows}
    assert X.outcomes(found).where("fault is null").count() == sum(fault is None for fault, _ in got.values())


@pytest.mark.parametrize("text", [
    "see https://doi.org/10.1000/ABC.12).", "(doi:10.1000/a(1)b))", "10.1000%2Fx%28y%29;", "10.123/short", "x10.1000/glued 10.1000/second?", "10.1000/a+b", "100% of 10.1000/q%zz", "10.1000/(a)(b)...", "", "10.1000/x\n10.2000/y",
])
def test_dois(spark, text):
    found = re.search(r"\b10\.\d{4,9}/[-._;()/:A-Z0-9]+", unquote(text), re.I)
    want = found[0].rstrip(".,;:!?") if found else None
    while want and want.endswith(")") and want.count(")") > want.count("("):
        want = want[:-1]
    assert spark.createDataFrame([(text,)], "t string").select(I.doi(F.col("t")).alias("x")).first().x == (want and want.lower())


def test_identity(spark):
    rows = [
        ("own:1", "10.1000/x", None, None, ("own:1", None, None, None)), (" ", "x 10.1000/Y.", None, None, ("doi:10.1000/y", "10.1000/y", None, None)), (None, "10.1000/y", "DOI 10.2000/z", None, ("doi:10.2000/z", "10.2000/z", None, None)),
        (None, "at https://www.jstor.org/stable/Ab%2012?x=1 ISBN 0306406152", None, None, ("jstor:ab 12", None, "https://www.jstor.org/stable/ab 12", None)), (None, "ISBN-10: 0-306-40615-2.", None, None, ("isbn:9780306406157", None, None, "9780306406157")),
        (None, "ISBN 978-0-306-40615-8", None, "080442957x", ("isbn:9780804429573", None, None, "9780804429573")), (None, "0306406152", None, "123", (None, None, None, None)), (None, None, None, None, (None, None, None, None)),
    ]
    frame = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, key string, page string, doi string, isbn string")
    got = [tuple(r.x) for r in sorted(frame.select("i", I.identity(F.col("page"), F.col("key"), F.col("doi"), F.col("isbn")).alias("x")).collect())]
    assert got == [r[4] for r in rows]
    page = spark.createDataFrame([("abcdef", 3), ("abcdef", 0), ("abcdef", 99), ("x" * 20_000, None)], "t string, second int").select(I.first_page(F.col("t"), F.col("second")).alias("p")).collect()
    assert [len(r.p) for r in page] == [3, 6, 6, 12_000]


def test_a_page_is_searched_once_for_each_identifier(spark):
    frame = spark.createDataFrame([("x" * 50 + " ISBN 0-306-40615-2",)], "page string")
    none = F.lit(None).cast("string")
    found = frame.select(I.identity(F.col("page"), none, none, none).alias("x")).select("x.*")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ISBN") == 1 and plan.count("jstor\\.org") == 1
    assert found.first().isbn == "9780306406157"
