"""Extraction schemas, and records held to them: types, required fields, and quotations located in their passage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T

#: The type of a field that quotes the passage, and the JSON types of the others (strings unless listed).
EVIDENCE = "evidence_span"
JSON_TYPES = {"number": "number", "integer": "integer", "boolean": "boolean", "array": "array"}
HINTS = {
    "entity_ref": "The name as written in the passage. Do not supply an identifier.",
    EVIDENCE: "Quote the passage exactly, word for word.",
    "fuzzy_date": 'Give the date as the passage words it ("the 15th ult.", "May 1862"); it is interpreted afterwards.',
}
#: What a JSON value must not be if its field is required.
EMPTY = {"STRING": "", "BIGINT": "0", "BOOLEAN": "false"}


def record_types(definition: dict) -> dict[str, dict]:
    """The fields of each record type by its id; ValueError for one without an id or declared twice."""
    out: dict[str, dict] = {}
    for kind in definition.get("record_types") or []:
        if not kind.get("id") or kind["id"] in out:
            raise ValueError(f"a record type has no id or is declared twice: {kind.get('id')!r}")
        out[kind["id"]] = kind.get("fields") or {}
    return out


def field_schema(spec: dict) -> dict:
    """A field as JSON Schema."""
    kind, said = spec.get("type", "string"), spec.get("description", "")
    hint = HINTS.get(kind, "")
    out = {"type": JSON_TYPES.get(kind, "string"), "description": hint if kind == "entity_ref" or (kind == EVIDENCE and not said) else f"{said} {hint}".strip() if kind == "fuzzy_date" else said}
    if kind == "enum":
        out["enum"] = list(spec.get("values", []))
    if kind == "number" and spec.get("range"):
        out["minimum"], out["maximum"] = spec["range"]
    return out | ({"items": {"type": "string"}} if kind == "array" else {})


def output_schema(definition: dict) -> dict:
    """JSON Schema of a model's answer: a list of records whose fields are those of all record types; ValueError if two disagree on a field's type."""
    kinds, fields = record_types(definition), {}
    if not kinds:
        raise ValueError("a schema needs a record type")
    for kind, own in kinds.items():
        for name, spec in own.items():
            new = field_schema(spec)
            if fields.setdefault(name, new)["type"] != new["type"]:
                raise ValueError(f"record type {kind!r} declares {name!r} with another type")
            if "enum" in new:
                fields[name]["enum"] = list(dict.fromkeys(fields[name].get("enum", []) + new["enum"]))
    record = {"type": "object", "properties": {"record_type": {"type": "string", "enum": list(kinds)}, "fields": {"type": "object", "properties": fields}}, "required": ["record_type", "fields"]}
    return {"type": "object", "properties": {"records": {"type": "array", "items": record}}, "required": ["records"]}


def definition_fault(definition: dict, prompt: str) -> str | None:
    """Why a schema can't give records that can be checked; None if it can."""
    try:
        output_schema(definition)
        for kind, fields in record_types(definition).items():
            if not fields:
                return f"record type {kind!r} declares no fields"
            if not any(spec.get("type") == EVIDENCE for spec in fields.values()):
                return f"record type {kind!r} declares no {EVIDENCE} field"
    except ValueError as e:
        return str(e)
    return None if re.search(r"\{\{-?\s*passage_text\s*-?\}\}", prompt) else "the prompt doesn't show the passage"


def located(passage: Column, quote: Column) -> Column:
    """(start, end) of a quotation in its passage, as it stands or with other white space between its words; null if it is blank or absent."""
    bare = F.regexp_replace(quote, r"(?U)^\s+|\s+$", "")
    literal = F.replace(bare, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit("(?U)\\Q"), F.regexp_replace(literal, r"(?U)\s+", F.lit(r"\\E\\s+\\Q")), F.lit("\\E"))
    # The first match of the pattern is the first place where its text stands.
    stands = F.when(F.contains(passage, quote), quote).otherwise(F.coalesce(F.regexp_substr(passage, pattern), F.lit("")))
    at = T.locate0(passage, stands)
    return F.when((bare != "") & (stands != ""), F.struct(at.alias("start"), (at + F.length(stands)).alias("end")))


def anchored(rows: DataFrame, passages: DataFrame, kinds: dict[str, dict]) -> DataFrame:
    """Records ``(extraction_id, passage_id, n, record_type, fields)`` with their first fault, or where their first quotation stands in the passage.

    ``kinds`` are as of :func:`record_types`.  A required field that is null, empty, zero or false is missing; every
    declared quotation must be found, and at least one must be given.  A passage's end and start are its own, not its document's.
    """
    declared = [(kind, name, bool(spec.get("required")), spec.get("type") == EVIDENCE) for kind, fields in kinds.items() for name, spec in fields.items()]
    specs = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("kind", "name", "required", "quoted"), one, strict=True)]) for one in declared]) if declared else F.expr("cast(array() as array<struct<kind string, name string, required boolean, quoted boolean>>)")
    joined = rows.join(passages.select("passage_id", F.col("text").alias("passage")), "passage_id", "left")
    parsed = joined.withColumn("parsed", F.try_parse_json("fields")).withColumn("own", F.filter(specs, lambda x: x["kind"] == F.col("record_type")))
    # Each step sees the one before as a column, so that no value is read twice.
    at = lambda x: F.try_variant_get("parsed", F.concat(F.lit("$['"), x["name"], F.lit("']")), "variant")
    valued = parsed.withColumn("own", F.transform("own", lambda x: F.struct(x["name"].alias("name"), x["required"].alias("required"), x["quoted"].alias("quoted"), F.try_variant_get(at(x), "$", "string").alias("text"), F.schema_of_variant(at(x)).alias("type"))))
    given = lambda x: x["text"].isNotNull() & F.coalesce(x["type"] != "VOID", F.lit(False))
    spans = valued.withColumn("own", F.transform("own", lambda x: x.withField("given", given(x)).withField("span", F.when(x["quoted"] & given(x) & (x["type"] == "STRING"), located(F.col("passage"), x["text"])))))

    def empty(x: Column) -> Column:
        nothing = F.startswith(x["type"], F.lit("ARRAY")) & (x["text"] == "[]") | F.startswith(x["type"], F.lit("OBJECT")) & (x["text"] == "{}")
        for of, value in EMPTY.items():
            nothing = nothing | ((x["type"] == of) & (x["text"] == value))
        return nothing

    missing = F.transform(F.filter("own", lambda x: x["required"] & (~x["given"] | empty(x))), lambda x: F.concat(F.lit("missing "), x["name"]))
    unfit = F.filter("own", lambda x: x["quoted"] & x["given"] & x["span"].isNull())
    unheld = F.transform(unfit, lambda x: F.concat(x["name"], F.when(x["type"] == "STRING", " is not in the passage").otherwise(" is no quotation")))
    quotes = F.transform(F.filter("own", lambda x: x["quoted"] & x["span"].isNotNull()), lambda x: x["span"])
    checked = spans.withColumn("missing", missing).withColumn("unheld", unheld).withColumn("quotes", quotes)
    no_object = ~F.coalesce(F.startswith(F.schema_of_variant("parsed"), F.lit("OBJECT")), F.lit(False))
    fault = (
        F.when(~F.coalesce(F.col("record_type").isin(*kinds), F.lit(False)), "unknown record type").when(no_object, "no fields")
        .otherwise(F.coalesce(F.get("missing", 0), F.get("unheld", 0), F.when(F.size("quotes") == 0, "quotes nothing")))
    )
    found = checked.withColumn("fault", fault)
    span = F.when(F.col("fault").isNull(), F.get("quotes", 0))
    return found.select("extraction_id", "passage_id", "n", "record_type", "fields", "fault", span["start"].cast("int").alias("evidence_start"), span["end"].cast("int").alias("evidence_end"))


def outcomes(rows: DataFrame) -> DataFrame:
    """(extraction_id, records, fault): an extraction is refused as a whole at its first faulty record."""
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("n", "fault")))
    return rows.groupBy("extraction_id").agg(F.count("*").alias("records"), first.alias("f")).select("extraction_id", "records", F.col("f.fault").alias("fault"))
