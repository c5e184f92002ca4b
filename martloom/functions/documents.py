"""Typed access to JSON documents. Values keep their JSON type, so a number is never read as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from martloom.functions.names import collapse_spaces, strip_all


def parse(text: Column) -> Column:
    """The document, or NULL for text that is not JSON or not an object."""
    value = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)


def member(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def kind(doc: Column, path: str = "$") -> Column:
    """JSON type name in Spark's spelling; empty for a missing member."""
    return F.coalesce(F.schema_of_variant(member(doc, path)), F.lit(""))


def is_text(doc: Column, path: str = "$") -> Column:
    return kind(doc, path) == "STRING"


def is_list(doc: Column, path: str = "$") -> Column:
    return F.startswith(kind(doc, path), F.lit("ARRAY"))


def is_object(doc: Column, path: str = "$") -> Column:
    return F.startswith(kind(doc, path), F.lit("OBJECT"))


def is_missing(doc: Column, path: str = "$") -> Column:
    return kind(doc, path).isin("", "VOID")


def is_number(doc: Column, path: str = "$") -> Column:
    """Numbers; true and false count as numbers, as they do in the documents' own rules."""
    return kind(doc, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")


def is_integer(doc: Column, path: str = "$") -> Column:
    return kind(doc, path).rlike(r"^(BIGINT|BOOLEAN|DECIMAL\(\d+,0\))")


def text(doc: Column, path: str = "$") -> Column:
    return F.when(is_text(doc, path), F.try_variant_get(doc, path, "string"))


def number(doc: Column, path: str = "$") -> Column:
    raw = F.try_variant_get(doc, path, "double")
    flag = F.try_variant_get(doc, path, "boolean").cast("double")
    return F.when(kind(doc, path) == "BOOLEAN", flag).when(is_number(doc, path), raw)


def items(doc: Column, path: str = "$") -> Column:
    """List members as documents; NULL when the member is missing or no list."""
    return F.when(is_list(doc, path), F.try_variant_get(doc, path, "array<variant>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once; a plain reuse would repeat the whole expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def within(cleaned: Column, max_length: int) -> Column:
    return F.when((F.length(cleaned) > 0) & (F.length(cleaned) <= max_length), cleaned)


def safe_text(value: Column, max_length: int, collapse: bool = True) -> Column:
    """Cleaned text, NULL when blank or too long."""
    cleaned = collapse_spaces(value) if collapse else strip_all(value)
    return let(cleaned, lambda c: within(c, max_length))


def safe_texts(values: Column, max_length: int) -> Column:
    """``safe_text`` for each entry; unusable entries become NULL."""
    return F.transform(F.transform(values, collapse_spaces), lambda c: within(c, max_length))
