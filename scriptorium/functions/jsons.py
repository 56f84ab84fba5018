"""JSON scalars: containment against a literal, key access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(column: Column, literal: object, path: str = "$") -> Column:
    """Whether JSON text contains ``literal`` (a plan-time value): objects recursively, arrays by element.

    Expanded when the plan is built, so the filter stays declarative; malformed JSON is false.
    """
    value = F.try_parse_json(column)
    return F.coalesce(_contains(value, literal, path), F.lit(False))


def _contains(value: Column, literal: object, path: str) -> Column:
    if isinstance(literal, dict):
        out = F.lit(True)
        for key, inner in literal.items():
            out = out & _contains(value, inner, f"{path}['{key}']")
        return out
    if isinstance(literal, list):
        items = F.try_variant_get(value, path, "array<variant>")
        out = items.isNotNull()
        for inner in literal:
            out = out & F.exists(items, _holds(inner))
        return out
    if literal is None:
        return F.is_variant_null(F.try_variant_get(value, path, "variant"))
    kind = "boolean" if isinstance(literal, bool) else "bigint" if isinstance(literal, int) else "double" if isinstance(literal, float) else "string"
    return F.try_variant_get(value, path, kind) == F.lit(literal)


def _holds(literal: object) -> Callable[[Column], Column]:
    return lambda item: F.coalesce(_contains(item, literal, "$"), F.lit(False))


def text_at(column: Column, key: str) -> Column:
    """A key's scalar as text, null if absent."""
    return F.get_json_object(column, f"$.{key}")
