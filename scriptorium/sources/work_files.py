"""Work files: markdown with a YAML header that lists span citations, and ``[^cN]`` marks in the body.

A bad header spoils its file; a bad citation spoils only itself.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # then every file is a row with that error
    yaml = None

#: The header's keys and the vocabularies of its fields.
KEYS = ("work", "title", "type", "status", "created", "claims", "citations")
TYPES = ("translation", "essay", "dossier", "script", "outline")
STATUSES = ("draft", "review", "published")
INTENTS = ("quotation", "translation", "support", "contrast", "background", "definition", "source", "see_also")
ROLES = ("asserts", "supports", "rebuts", "context")
FIELDS = ("id", "intent", "role", "document_id", "char_start", "char_end", "quoted_text", "edition", "edition_key", "locator")
DEFINITION, MARK = re.compile(r"(?m)^\[\^c\d+\]:[^\n]*\n?"), re.compile(r"\[\^(c\d+)\]")

WORKS = (
    "path string, work string, title string, type string, status string, created date, claims array<string>, "
    "citations array<struct<id string, intent string, role string, document_id string, char_start int, char_end int, quoted_text string, edition string, edition_key string, locator map<string,string>>>, "
    "entry_errors array<struct<id string, message string>>, markers array<string>, body string, header_sha string, error string"
)
_COLUMNS = ["path", "work", "title", "type", "status", "created", "claims", "citations", "entry_errors", "markers", "body", "header_sha", "error"]


def _citation(entry: object) -> dict:
    """A valid citation of the header, or ValueError with what is wrong with it."""
    if not isinstance(entry, dict):
        raise ValueError(f"no mapping: {entry!r}")
    if strange := sorted(set(entry) - set(FIELDS)):
        raise ValueError(f"unknown fields {strange}")
    number = lambda x: isinstance(x, int) and not isinstance(x, bool)
    tests = {
        "id": isinstance(entry.get("id"), str) and re.fullmatch(r"c[0-9]+", entry["id"]),
        "intent": entry.get("intent") in INTENTS,
        "role": entry.get("role") is None or entry["role"] in ROLES,
        "document_id": isinstance(entry.get("document_id"), str | int) and not isinstance(entry["document_id"], bool),
        "char_start": number(entry.get("char_start")) and entry["char_start"] >= 0,
        "char_end": number(entry.get("char_end")) and number(entry.get("char_start")) and entry["char_end"] > entry["char_start"],
        "quoted_text": isinstance(entry.get("quoted_text"), str) and entry["quoted_text"].strip(),
        "edition": isinstance(entry.get("edition"), str | None),
        "edition_key": isinstance(entry.get("edition_key"), str | None),
        "locator": isinstance(entry.get("locator", {}), dict),
    }
    if wrong := [name for name, good in tests.items() if not good]:
        raise ValueError(f"invalid {', '.join(wrong)}")
    return {name: entry.get(name) for name in FIELDS} | {"document_id": str(entry["document_id"]), "locator": {str(k): str(v) for k, v in entry.get("locator", {}).items()}}


def _header(text: str) -> object:
    """A header read by LibYAML where it is there, which is several times faster; what that refuses is judged by the plain parser."""
    try:
        return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return yaml.safe_load(text)


def parse_work(data: bytes, path: str) -> dict:
    """One work file as a row of ``WORKS``; ValueError if its header can't be read."""
    if yaml is None:
        raise ValueError("PyYAML is not installed")
    text = data.decode("utf-8")
    if not text.startswith("---\n"):
        raise ValueError("no front matter")
    end = text.find("\n---\n", 4)
    if end < 0:
        raise ValueError("front matter isn't closed")
    header, body = text[4:end], text[end + 5 :]
    try:
        raw = _header(header)
    except yaml.YAMLError as e:
        raise ValueError(f"invalid YAML: {e}") from e
    if not isinstance(raw, dict):
        raise ValueError("front matter is no mapping")
    if strange := sorted(str(k) for k in set(raw) - set(KEYS)):
        raise ValueError(f"unknown keys {strange}")
    claims, entries = raw.get("claims") or [], raw.get("citations", [])
    created = raw.get("created")
    if isinstance(created, str):
        created = datetime.date.fromisoformat(created)
    tests = {
        "work": isinstance(raw.get("work"), str), "title": isinstance(raw.get("title"), str), "type": raw.get("type") in TYPES, "status": raw.get("status") in STATUSES, "created": isinstance(created, datetime.date),
        "claims": isinstance(claims, list) and all(isinstance(x, str) for x in claims), "citations": isinstance(entries, list),
    }
    if wrong := [name for name, good in tests.items() if not good]:
        raise ValueError(f"invalid {', '.join(wrong)}")
    citations, errors = [], []
    for entry in entries:
        try:
            citations.append(_citation(entry))
        except ValueError as e:
            own = entry.get("id") if isinstance(entry, dict) else None
            errors.append({"id": own if isinstance(own, str) else None, "message": str(e)})
    return {
        "path": path, "work": raw["work"], "title": raw["title"], "type": raw["type"], "status": raw["status"], "created": created, "claims": claims, "citations": citations, "entry_errors": errors,
        "markers": MARK.findall(DEFINITION.sub("", body)), "body": body, "header_sha": hashlib.sha256(header.encode()).hexdigest(), "error": None,
    }


def read_works(files: DataFrame) -> DataFrame:
    """Works of ``files(path, content)``; a file whose header can't be read is a row with an error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append(parse_work(content, path))
                except ValueError as e:
                    rows.append(dict.fromkeys(_COLUMNS) | {"path": path, "error": str(e)})
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.select("path", "content").mapInPandas(run, WORKS)


def list_works(spark: SparkSession, folder: str) -> DataFrame:
    """The work files under a folder (path, content): markdown, but for README.md, names that begin with an underscore, and copies that a file synchroniser left."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    spare = (name == "README.md") | F.startswith(name, F.lit("_")) | F.contains(name, F.lit("conflicted copy")) | F.contains(name, F.lit(".sync-conflict-"))
    return found.where(~spare).select("path", "content")
