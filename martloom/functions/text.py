"""Text rules: question normalisation, secret markers, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from martloom.functions.names import collapse_spaces

# Substrings that make machine output unacceptable.
SECRET_MARKERS = ("api_key", "secret", "password", "token")
SPEC_SECRET_MARKERS = ("api_key", "secret", "password")
PLAN_SECRET_MARKERS = ("api_key", "secret")
REDACTED = "[redacted]"


def normalize_question(question: Column) -> Column:
    """Lower case, single spaces, no closing spaces or sentence marks."""
    return F.regexp_replace(F.lower(collapse_spaces(question)), r"[ ?!.]+$", "")


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(m)) for m in markers))


def redact(text: Column, secrets: list[str]) -> Column:
    """Literal values replaced one after the other; unset values are skipped."""
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(REDACTED)), (s for s in secrets if s), text)
