"""Agent output to JSON text: fences, surrounding prose and stray commas are forgiven."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import FENCE_PATTERN, TRAILING_COMMA_PATTERN
from .text import let


def whole_json(text: Column) -> Column:
    """``text`` if it is one JSON value and nothing else: as a list's only element it still reads as one."""
    alone = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")) == 1
    return F.when((text != "") & F.try_parse_json(text).isNotNull() & alone, text)


def repaired(text: Column) -> Column:
    """JSON text found in an agent's answer, or null. Never an empty object in its place."""
    bare = F.trim(F.regexp_replace(F.trim(text), "(?m)" + FENCE_PATTERN, ""))
    return let(
        bare,
        lambda b: F.coalesce(
            whole_json(b),
            let(F.regexp_extract(b, r"(?s)\{.*\}", 0), whole_json),
            let(F.regexp_extract(b, r"(?s)\[.*\]", 0), whole_json),
            let(F.regexp_replace(b, TRAILING_COMMA_PATTERN, "$1"), whole_json),
        ),
    )


def as_object(json: Column) -> Column:
    """The one object of a payload: itself, or the only element of a one-element list."""

    def only(items: Column) -> Column:
        return F.when((F.size(items) == 1) & F.get(items, F.lit(0)).startswith("{"), F.get(items, F.lit(0)))

    return F.when(json.rlike(r"^\s*\{"), json).when(
        json.rlike(r"^\s*\["), let(F.from_json(json, "array<string>"), only)
    )


def open_object(json: Column) -> Column:
    """An object of unknown fields, in document order; nested values stay JSON text."""
    return F.from_json(json, "map<string,string>")
