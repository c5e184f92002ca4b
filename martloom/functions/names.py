"""Identifier rules shared by headers, mappings and specs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_NAME = r"^[A-Za-z_][A-Za-z0-9_]{0,63}$"
# Every character that counts as whitespace when text is stripped.
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a pattern.
WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip_all(col: Column) -> Column:
    """Strip every kind of leading and trailing whitespace, not only spaces. No pattern is involved."""
    return F.btrim(col, F.lit(SPACES))


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, rf"{WHITESPACE}+", " "))


def is_safe_name(col: Column) -> Column:
    # Java's $ also matches before a final line break, which a full match would reject.
    return F.coalesce(col.rlike(SAFE_NAME) & ~F.contains(col, F.lit("\n")), F.lit(False))


def _header_name(col: Column) -> Column:
    underscored = F.regexp_replace(strip_all(col), r"[^A-Za-z0-9_]+", "_")
    return F.upper(F.btrim(underscored, F.lit("_")))


def _header_prefix(name: Column) -> Column:
    return F.when(name.rlike(r"^[0-9]"), F.concat(F.lit("COL_"), name)).otherwise(name)


def normalize_header(col: Column) -> Column:
    """Upper-case column name with runs of other characters as one underscore."""
    return _header_prefix(_header_name(col))


def normalize_headers(cols: Column | str) -> Column:
    """``normalize_header`` over an array, each name computed once."""
    return F.transform(F.transform(cols, _header_name), _header_prefix)
