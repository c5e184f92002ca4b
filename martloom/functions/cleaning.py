"""Tolerant casts and cleaning used by the staging and intermediate layers.

Every cast turns a bad value into NULL instead of failing the job, which is what a text load needs
under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
WHOLE = "decimal(38,0)"


def clean_text(col: Column) -> Column:
    """Trim spaces and turn the empty string into NULL. The word NULL is kept."""
    return F.nullif(F.trim(col), F.lit(""))


def clean_date(col: Column) -> Column:
    """Date from year-first or slash formats; month-first wins over day-first.

    The shape guards keep Spark's lenient parser from accepting partial dates, and the common
    year-month-day shape takes the cast, which is cheaper than a format-driven parse.
    """
    return F.coalesce(
        F.when(col.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), col.try_cast("date")),
        F.when(col.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(col, "yyyy/M/d")),
        F.when(
            col.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
            F.coalesce(F.try_to_date(col, "M/d/yyyy"), F.try_to_date(col, "d/M/yyyy")),
        ),
    )


def clean_whole_number(col: Column) -> Column:
    return col.try_cast(WHOLE)


def clean_money(col: Column) -> Column:
    return col.try_cast(MONEY)


def month_of(date_col: Column) -> Column:
    return F.trunc(date_col, "month")


def net_revenue(revenue: Column, quantity: Column, unit_price: Column, discount: Column) -> Column:
    """Stated revenue, else quantity times price less the discount (a missing discount is zero).

    A product too large for its type is NULL.
    """
    product = F.try_subtract(F.try_multiply(quantity, unit_price), F.coalesce(discount, F.lit(0).cast(MONEY)))
    return F.coalesce(revenue, product)


def gross_margin(net: Column, cost: Column) -> Column:
    return F.try_subtract(net, F.coalesce(cost, F.lit(0).cast(MONEY)))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(col: Column) -> Column:
    """Chart value from display text: thousands commas dropped, blank text is 0, other text NULL."""
    text = F.trim(F.regexp_replace(col, ",", ""))
    return F.when(text == "", F.lit(0.0)).when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def is_number_text(col: Column) -> Column:
    """Whether text reads as a number once commas are dropped; words for infinity and NaN count."""
    text = F.trim(F.regexp_replace(col, ",", ""))
    return text.rlike(PLAIN_NUMBER) | text.rlike(r"^[+-]?(?i:inf|infinity|nan)$")


def humanize(col: Column) -> Column:
    """Label from an identifier: underscores to spaces, every word capitalised."""
    return F.initcap(F.trim(F.regexp_replace(col, r"[_\s]+", " ")))


# Words in a field name that suggest a display format.
CURRENCY_WORDS = "revenue|margin|cost|sales|amount"
PERCENT_WORDS = "rate|percent|ratio"


def format_hint(field: Column) -> Column:
    name = F.lower(field)
    return F.when(name.rlike(CURRENCY_WORDS), "currency").when(name.rlike(PERCENT_WORDS), "percent")
