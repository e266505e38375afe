"""Blank tests, normal forms, slugs, hashes and cell text."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import ENTITY_STOPWORDS


def is_blank(col: Column, dtype: T.DataType | None = None) -> Column:
    """Null, empty string, empty array and empty map all count as "no value"."""
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return col.isNull() | (F.size(col) == 0)
    if dtype is None or isinstance(dtype, T.StringType):
        return col.isNull() | (col == F.lit(""))
    return col.isNull()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def cell_under(header: Column, row: Column, name: str) -> Column:
    """The cell of a row below a header name: of a repeated name the last one, null where the row is too short."""
    from_end = F.array_position(F.reverse(header), F.lit(name))
    return F.when(from_end > 0, F.get(row, (F.size(header) - from_end).cast("int")))


def map_of_last(entries: Column) -> Column:
    """A map from (key, value) structs; a repeated key keeps its last value, a null key goes."""
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: e["key"].isNotNull() & ~later(e, i)))


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def text_normal(col: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(col.cast("string")), "[^a-z0-9]+", "")


def slug(col: Column, max_chars: int = 60) -> Column:
    raw = F.regexp_replace(F.lower(col.cast("string")), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(raw, "^-+|-+$", ""), 1, max_chars)
    return F.when(F.coalesce(cut, F.lit("")) == "", "output").otherwise(cut)


def file_key(col: Column, max_chars: int = 80) -> Column:
    """Readable slug plus eight hash digits, so two labels never share a key."""
    raw = F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9._-]+", "-")
    readable = F.regexp_replace(raw, "^-+|-+$", "")
    readable = F.when(readable == "", "unit").otherwise(readable)
    return F.concat_ws("-", F.substring(readable, 1, max_chars), F.substring(F.sha1(col), 1, 8))


def unit_key(target: Column, dimension: Column) -> Column:
    return F.concat_ws("::", target, dimension)


def strip_markup(col: Column) -> Column:
    """Tags and entities to spaces, white space collapsed. The whole text is kept."""
    no_tags = F.regexp_replace(F.coalesce(col, F.lit("")), "<[^>]+>", " ")
    no_entities = F.regexp_replace(no_tags, "&[a-z]+;|&#\\d+;", " ")
    return F.trim(F.regexp_replace(no_entities, "\\s+", " "))


def content_hash(col: Column) -> Column:
    return F.when(F.coalesce(col, F.lit("")) != "", F.sha2(col, 256))


def cell_text(col: Column, dtype: T.DataType) -> Column:
    """One flat cell: null is empty, lists are joined by "; ", maps and structs are JSON."""
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(col, lambda x: cell_text(x, dtype.elementType)), "; "), F.lit(""))
    if isinstance(dtype, (T.MapType, T.StructType)):
        return F.coalesce(F.to_json(col), F.lit(""))
    return F.coalesce(col.cast("string"), F.lit(""))


@cache
def _compatible_forms() -> dict[str, str]:
    """Every character whose compatibility form has ASCII letters or digits, and these: one, or several as in a ligature."""
    forms = {}
    for code in (*range(0x00A0, 0xD800), *range(0xE000, 0x20000)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c.isascii() and c.isalnum())
        if base:
            forms[chr(code)] = base
    return forms


def fold_accents(col: Column) -> Column:
    forms = _compatible_forms()
    single = {c: f for c, f in forms.items() if len(f) == 1 and ord(c) < 0x10000}
    several = {c: f for c, f in forms.items() if c not in single}
    no_marks = F.regexp_replace(col, "\\p{M}+", "")
    plain = F.translate(no_marks, "".join(single), "".join(single.values()))
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelt = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    # Few names have a character that stands for several, so few are taken apart.
    whole = F.when(plain.rlike("[^\\x00-\\x7f]"), spelt).otherwise(plain)
    return F.when(col.rlike("[^\\x00-\\x7f]"), whole).otherwise(col)


def entity_slug(name: Column) -> Column:
    """Identity of a name: accents, punctuation and corporate suffixes do not matter.

    A name with nothing Latin in it gets a hash, so that two such names stay apart.
    """
    text = F.regexp_replace(F.lower(fold_accents(F.coalesce(name, F.lit("")))), "[^a-z0-9\\s]", " ")
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")

    def chosen(every: Column) -> Column:
        kept = F.filter(every, lambda w: ~w.isin(*ENTITY_STOPWORDS))
        hashed = F.concat(F.lit("x-"), F.sha1(F.trim(name)))
        return (
            F.when(F.size(kept) > 0, F.array_join(kept, "-"))
            .when(F.size(every) > 0, F.array_join(every, "-"))
            .when(F.trim(F.coalesce(name, F.lit(""))) == "", "unknown")
            .otherwise(hashed)
        )

    return let(words, chosen)


def entity_key(name: Column, kind: Column) -> Column:
    return F.concat_ws(":", kind, entity_slug(name))


def predicate_name(col: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(col)), "\\s+", "_")
    return F.when(F.coalesce(name, F.lit("")) == "", "related_to").otherwise(name)


def safe_double(col: Column) -> Column:
    """Number from text with currency sign and thousands marks; null when it is none."""
    return F.translate(col.cast("string"), "$,", "").try_cast("double")
