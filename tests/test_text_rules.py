"""Cleaning, type detection and header rules against plain Python."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal, InvalidOperation

import pytest
from pyspark.sql import functions as F

from martloom.functions import cleaning as C
from martloom.functions import names as N
from martloom.functions import text as X
from martloom.operators import profiling as P

NUMBERS = [
    "1", "+1", "-12", "1_000", "_1", "1_", "1__0", "01", "1.0", ".5", "5.", "1e5", "1E-3", "1e", "e5", "NaN", "nan12",
    "snan", "inf", "-Infinity", "infinit", "0x10", "1,000", "--1", "", "abc", "1.2.3", "½", "1 0",
]
DATES = [
    "2026-01-04", "2026-1-4", "2026/01/04", "01/04/2026", "13/04/2026", "31/02/2026", "2026-02-30", "2026-13-01",
    "2026", "2026-01", "20260104", "2026-001-04", "0000-01-01", "04-01-2026", "1/2/26", "yesterday", "2026-01-04T00:00:00",
]


def one_column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def results(df, *cols):
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def is_int(v):
    try:
        int(v)
        return "." not in v
    except ValueError:
        return False


def is_dec(v):
    try:
        Decimal(v)
        return True
    except (InvalidOperation, ValueError):
        return False


def is_date(v):
    for f in ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y"):
        try:
            datetime.strptime(v, f)
            return True
        except ValueError:
            pass
    try:
        date.fromisoformat(v)
        return True
    except ValueError:
        return False


def test_number_spellings_agree_with_python(spark):
    found = results(one_column(spark, NUMBERS), P.is_integer_text(F.col("v")), P.is_decimal_text(F.col("v")))
    assert found == [(is_int(v), is_dec(v)) for v in NUMBERS]


def test_date_spellings_agree_with_python(spark):
    found = results(one_column(spark, DATES), P.is_date_text(F.col("v")))
    assert found == [(is_date(v),) for v in DATES]


def test_clean_date_prefers_month_first(spark):
    found = results(one_column(spark, ["01/04/2026", "13/04/2026", "2026-01", "x", None]), C.clean_date(F.col("v")))
    assert found == [(date(2026, 1, 4),), (date(2026, 4, 13),), (None,), (None,), (None,)]


def test_decimal_casts_round_half_up_and_tolerate_text(spark):
    found = results(
        one_column(spark, ["2.345", "2.5", "abc", "", None]),
        C.clean_money(F.col("v")), C.clean_whole_number(F.col("v")),
    )
    assert found[0] == (Decimal("2.35"), Decimal("2"))
    assert found[1] == (Decimal("2.50"), Decimal("3"))
    assert found[2:] == [(None, None)] * 3


def test_the_three_null_rules_differ(spark):
    from martloom.sources.raw_csv import nulls_applied

    values = ["", " ", "NULL", "null", "Null", " NULL ", "\tx\t"]
    v = F.col("v")
    found = results(one_column(spark, values), nulls_applied(v), C.clean_text(v), P.meaningful(v))
    assert found == [
        (None, None, None), (" ", None, None), (None, "NULL", None), (None, "null", None), ("Null", "Null", "Null"),
        (" NULL ", "NULL", None), ("\tx\t", "\tx\t", "x"),
    ]


@pytest.mark.parametrize("text", ["  a b  ", " x　", "\x1cq\x85", "", " \n\t", "a b"])
def test_strip_matches_python(spark, text):
    assert results(one_column(spark, [text]), N.strip_all(F.col("v"))) == [(text.strip(),)]


def test_header_normalisation(spark):
    names = ["Order ID", " order-id ", "2nd value", "__x__", "¿?", "a.b c"]
    found = results(one_column(spark, names), N.normalize_header(F.col("v")))
    assert [r[0] for r in found] == ["ORDER_ID", "ORDER_ID", "COL_2ND_VALUE", "X", "", "A_B_C"]


def test_safe_name_is_a_full_match(spark):
    names = ["abc", "_a1", "1a", "a-b", "a" * 64, "a" * 65, "abc\n", "", None]
    found = results(one_column(spark, names), N.is_safe_name(F.col("v")))
    assert [r[0] for r in found] == [True, True, False, False, True, False, False, False, False]


def test_question_normalisation(spark):
    asked = ["  What  SOLD\tbest ?!. ", "what sold best", "a? b?"]
    found = results(one_column(spark, asked), X.normalize_question(F.col("v")))
    assert [r[0] for r in found] == ["what sold best", "what sold best", "a? b"]


def test_redaction_skips_unset_values(spark):
    found = results(one_column(spark, ["pw=s3cr3t, key=k"]), X.redact(F.col("v"), ["s3cr3t", "", None]))
    assert found == [("pw=[redacted], key=k",)]


def test_display_numbers(spark):
    values = ["1,234.5", " 7 ", "", "n/a", "1e3", "NaN", "-.5"]
    found = results(one_column(spark, values), C.to_number(F.col("v")), C.is_number_text(F.col("v")))
    assert found == [
        (1234.5, True), (7.0, True), (0.0, False), (None, False), (1000.0, True), (None, True), (-0.5, True),
    ]


def test_profile_of_an_empty_table_lists_every_column(spark):
    df = spark.createDataFrame([], "pos long, a string, b_id string")
    rows = {r["raw_column_name"]: r for r in P.profile(df, ["a", "b_id"], F.col("pos")).collect()}
    assert set(rows) == {"a", "b_id"}
    assert rows["a"]["detected_type"] == "unknown" and rows["a"]["null_rate"] == 0.0
    assert rows["a"]["sample_values"] == []


def test_samples_are_the_first_distinct_values_in_file_order(spark):
    values = ["b", "a", "b", " ", "d", "c", "NULL", "e", "f", "a"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, v string").repartition(4)
    row = P.profile(df, ["v"], F.col("pos")).collect()[0]
    assert row["sample_values"] == ["b", "a", "d", "c", "e"]
    assert (row["null_count"], row["unique_count"], row["null_rate"]) == (2, 6, 0.2)
