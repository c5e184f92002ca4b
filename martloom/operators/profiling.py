"""Column profiles of a text table: nulls, exact distinct counts, first samples and detected types.

The table is turned into (column, value) cells and aggregated to one row per (column, value) with partial aggregation on the
map side, so a value that fills a third of a column crosses the shuffle once per task. Every later
step, including the type tests, works on distinct values. Types alone (``detect_types``) need no values: they are folded from masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martloom.functions.names import normalize_header, strip_all
from martloom.sources.inline import rows

SAMPLE_SIZE = 5
# Words read as missing, and words read as booleans.
NULL_WORDS = ("", "NULL", "null")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "0", "1")
# The number spellings accepted by the parsers the profile has to agree with.
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
DECIMAL = (
    r"^[+-]?(([0-9_]*[0-9][0-9_]*\.?[0-9_]*|\.[0-9_]*[0-9][0-9_]*)(_*[eE][+-]?[0-9_]*[0-9][0-9_]*)?"
    r"|(?i:inf|infinity|s?nan[0-9]*))$"
)


def meaningful(col: Column) -> Column:
    """Stripped text, NULL for the words that mean missing."""
    text = strip_all(col)
    return F.when(~text.isin(*NULL_WORDS), text)


def is_integer_text(col: Column) -> Column:
    return col.rlike(INTEGER)


def is_decimal_text(col: Column) -> Column:
    return is_integer_text(col) | col.rlike(DECIMAL)


def is_date_text(col: Column) -> Column:
    """Year-first or slash dates; both month-first and day-first count. Year zero is no date."""
    dashed = F.when(col.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), col.try_cast("date"))
    packed = F.when(col.rlike(r"^\d{8}$"), F.try_to_date(col, "yyyyMMdd"))
    slashed = F.when(col.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(col, "yyyy/M/d"))
    either = F.when(
        col.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
        F.coalesce(F.try_to_date(col, "M/d/yyyy"), F.try_to_date(col, "d/M/yyyy")),
    )
    found = F.coalesce(dashed, slashed, either, packed)
    # Eight to ten characters bound every accepted shape, so longer text skips the patterns.
    return F.when(F.length(col).between(8, 10), found.isNotNull() & (F.year(found) > 0)).otherwise(False)


def is_identifier_name(name: Column) -> Column:
    lowered = F.lower(strip_all(name))
    return (lowered == "id") | F.endswith(lowered, F.lit("_id")) | F.endswith(lowered, F.lit(" id"))


def value_counts(df: DataFrame, columns: list[str], position: Column) -> DataFrame:
    """(raw_column_name, value, row_total, first_seen); missing values share one NULL row per column."""
    # Inline rather than unpivot: plans around an unpivot never compare equal, so the two readers of
    # this aggregation would each run the scan and the shuffle again.
    cell = lambda c: F.struct(F.lit(c).alias("raw_column_name"), F.col(c).alias("value"))
    long = df.select(position.alias("__position"), F.inline(F.array(*(cell(c) for c in columns))))
    # The cleaned value is a column before it is a key: grouping by an expression gives each reader of
    # the result its own plan, and Spark could not reuse one shuffle for all of them.
    cells = long.select("__position", "raw_column_name", meaningful(F.col("value")).alias("value"))
    return cells.groupBy("raw_column_name", "value").agg(
        F.count("*").alias("row_total"), F.min("__position").alias("first_seen")
    )


# Types by the order in which they are tried, one bit each.
MASK = {"boolean": 1, "integer": 2, "decimal": 4, "date": 8}
ANY = sum(MASK.values())


def type_mask(value: Column) -> Column:
    """The types that a cleaned value could have, as bits. A missing value allows all.

    The first character settles most values: no pattern is tried on text that begins like no number, date or boolean word.
    """
    bit = lambda test, kind: F.when(test, MASK[kind]).otherwise(0)
    number = (
        F.when(is_integer_text(value), MASK["integer"] | MASK["decimal"])
        .when(is_decimal_text(value), MASK["decimal"]).otherwise(0)
    )
    word = F.when(F.length(value) <= 5, bit(F.lower(value).isin(*BOOLEAN_WORDS), "boolean")).otherwise(0)
    head = F.ascii(value)
    digits = head.between(ord("0"), ord("9"))
    found = (
        F.when(digits, number.bitwiseOR(word).bitwiseOR(bit(is_date_text(value), "date")))
        .when(F.substring(value, 1, 1).isin(*"+-._iInNsS"), number.bitwiseOR(word))
        .otherwise(word)
    )
    return F.when(value.isNotNull(), found).otherwise(ANY)


def _detected_type(filled: Column, mask: Column) -> Column:
    """The first type that all values of a column allow; ``filled`` counts its values that are not missing."""
    found = F.when(filled == 0, "unknown").when(is_identifier_name(F.col("raw_column_name")), "identifier")
    for kind, bit in MASK.items():
        found = found.when(mask.bitwiseAND(bit) != 0, kind)
    return found.otherwise("string")


def detect_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(raw_column_name, detected_type) without a look at distinct values.

    Each cell is a mask of the types it allows, and masks of a column are folded with ``and`` in every task, so one row per column and task
    is all that is shuffled. A table without rows still gets one row per column.
    """
    # A name that marks an identifier settles the type, so its values are not tested.
    cell = lambda c: F.struct(F.lit(c).alias("raw_column_name"), meaningful(F.col(c)).alias("value"))
    cells = df.select(F.inline(F.array(*(cell(c) for c in columns))))
    tested = F.when(is_identifier_name(F.col("raw_column_name")), ANY).otherwise(type_mask(F.col("value")))
    found = cells.groupBy("raw_column_name").agg(F.count("value").alias("filled"), F.bit_and(tested).alias("mask"))
    listed = rows(df.sparkSession, ["raw_column_name"], [(c,) for c in columns])
    whole = listed.join(found, "raw_column_name", "left")
    return whole.select("raw_column_name", _detected_type(F.coalesce("filled", F.lit(0)), F.coalesce("mask", F.lit(ANY))).alias("detected_type"))


def summarize(counts: DataFrame) -> DataFrame:
    """One row per column from ``value_counts``: null and distinct counts, and the detected type."""
    value = F.col("value")
    # A name that marks an identifier settles the type, so its values are not tested.
    tested = F.when(is_identifier_name(F.col("raw_column_name")), ANY).otherwise(type_mask(value))
    summary = counts.groupBy("raw_column_name").agg(
        F.sum("row_total").alias("row_count"),
        F.sum(F.when(value.isNull(), F.col("row_total")).otherwise(0)).alias("null_count"),
        # Counting first_seen, as samples carry row_total, leaves both readers of the value counts
        # with the same columns, and Spark then runs that aggregation once for the two.
        F.count(F.when(value.isNotNull(), F.col("first_seen"))).alias("unique_count"),
        F.bit_and(tested).alias("mask"),
    )
    rate = F.round(F.col("null_count") / F.col("row_count"), 4)
    return summary.select(
        "raw_column_name",
        normalize_header(F.col("raw_column_name")).alias("normalized_column_name"),
        _detected_type(F.col("unique_count"), F.col("mask")).alias("detected_type"),
        "row_count",
        "null_count",
        rate.alias("null_rate"),
        "unique_count",
    )


def samples(counts: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """The first distinct values of each column. The rank filter is a top-k: every task keeps at
    most ``size`` rows per column before the shuffle, so the list is bounded too."""
    # Missing values rank last and are dropped after the cut; dropped before it, they would make this
    # a different aggregation from the one the summary reads.
    first = W.partitionBy("raw_column_name").orderBy(F.col("value").isNull(), "first_seen", "value")
    kept = counts.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= size)
    listed = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("__rank", "value", "row_total"))))
    found = kept.groupBy("raw_column_name").agg(
        F.transform(listed, lambda item: item["value"]).alias("sample_values")
    )
    return found.filter(F.size("sample_values") > 0)


def _with_index(profile: DataFrame, columns: list[str]) -> DataFrame:
    index = F.create_map(*(F.lit(part) for pair in ((c, i) for i, c in enumerate(columns)) for part in pair))
    return profile.withColumn("column_index", index[F.col("raw_column_name")])


def profile(df: DataFrame, columns: list[str], position: Column) -> DataFrame:
    """The full profile. ``position`` is the row's place in the file; it decides which samples are
    first. A table without rows still gets one row per column."""
    counts = value_counts(df, columns, position)
    found = summarize(counts).join(samples(counts), "raw_column_name", "left")
    listed = rows(df.sparkSession, ["raw_column_name"], [(c,) for c in columns])
    complete = listed.join(found, "raw_column_name", "left").select(
        "raw_column_name",
        normalize_header(F.col("raw_column_name")).alias("normalized_column_name"),
        F.coalesce("detected_type", F.lit("unknown")).alias("detected_type"),
        F.coalesce("null_count", F.lit(0)).cast("long").alias("null_count"),
        F.coalesce("null_rate", F.lit(0.0)).alias("null_rate"),
        F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )
    return _with_index(complete, columns)
