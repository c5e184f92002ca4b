"""Semantic mappings: what is effective, what a suggestion breaks, edits, column sets and hints.

Rules that look at a dataset's columns together work on arrays of them. Such an array is as long as
one table is wide, never as long as a table is tall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions import documents as D
from martloom.functions.names import is_safe_name, strip_all
from martloom.functions.text import PLAN_SECRET_MARKERS, contains_any
from martloom.operators.unnest import unbroadcast, unnest
from martloom.plans.spec import MEASURE_ROLES, NUMERIC_TYPES

# Roles a mapping may have, and those that make a column a label.
ROLES = ("identifier", "date_time", "measure_column", "metric_candidate", "dimension", "unknown")
DIMENSION_ROLES = ("identifier", "dimension", "date_time")
REVIEW_BELOW = 0.75
# Columns that describe a transaction, and columns that tell a table's grain.
TRANSACTION_COLUMNS = ("channel", "payment_method", "payment_terms", "order_priority", "priority", "status")
TRANSACTION_SUFFIXES = ("_status", "_type")
GRAIN_COLUMNS = ("order_id", "invoice_id", "transaction_id")
GRAIN_SUFFIXES = ("_line_id", "_item_id")


def effective(mappings: DataFrame) -> DataFrame:
    """Included mappings under their approved (else suggested) name and role, if name and role are usable."""
    name = F.coalesce(F.nullif("approved_name", F.lit("")), "suggested_name")
    role = F.coalesce(F.nullif("approved_role", F.lit("")), "semantic_role")
    return (
        mappings.filter(F.col("include_in_model"))
        .withColumns({"name": name, "role": role})
        .filter(is_safe_name(F.col("name")) & (F.col("role") != "unknown"))
    )


def column_flags(mappings: DataFrame) -> DataFrame:
    """Which sets each effective column belongs to."""
    measure = F.col("role").isin(*MEASURE_ROLES) | F.col("detected_type").isin(*NUMERIC_TYPES)
    return mappings.withColumns(
        {
            "is_measure": measure,
            "is_date": (F.col("role") == "date_time") | (F.col("detected_type") == "date"),
            "is_dimension": F.col("role").isin(*DIMENSION_ROLES) | ~measure,
            "is_identifier": (F.col("role") == "identifier") | (F.col("detected_type") == "identifier"),
        }
    )


def column_sets(mappings: DataFrame) -> DataFrame:
    """Per dataset, the column names in each set."""
    named = lambda flag: F.collect_set(F.when(F.col(flag), F.col("name")))
    return column_flags(mappings).groupBy("dataset_id").agg(
        F.collect_set("name").alias("all_columns"),
        named("is_measure").alias("measures"),
        named("is_date").alias("dates"),
        named("is_dimension").alias("label_columns"),
        named("is_identifier").alias("identifiers"),
    )


def _in_order() -> Column:
    listed = F.array_sort(F.collect_list(F.struct("column_index", "name")))
    return F.transform(listed, lambda item: item["name"])


def role_groups(mappings: DataFrame) -> DataFrame:
    """Column names per dataset and role, in column order."""
    return mappings.groupBy("dataset_id", "role").agg(_in_order().alias("columns"))


def _ends(name: Column, suffixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for suffix in suffixes:
        found = found | F.endswith(name, F.lit(suffix))
    return found


def entity_hints(mappings: DataFrame) -> DataFrame:
    """Entities (an ``_id`` column with sibling columns), transaction attributes and grain evidence."""
    names = mappings.groupBy("dataset_id").agg(_in_order().alias("names"))
    ids = F.filter("names", lambda n: F.endswith(n, F.lit("_id")))

    def entity(key: Column) -> Column:
        stem = F.substring(key, F.lit(1), F.length(key) - 3)
        members = F.filter("names", lambda n: (n == key) | F.startswith(n, F.concat(stem, F.lit("_"))))
        return F.struct(stem.alias("hint"), members.alias("columns"), F.lit(2).alias("at_least"))

    attributes = F.filter(
        "names", lambda n: n.isin(*TRANSACTION_COLUMNS) | _ends(n, TRANSACTION_SUFFIXES)
    )
    grain = F.filter("names", lambda n: n.isin(*GRAIN_COLUMNS) | _ends(n, GRAIN_SUFFIXES))
    fixed = F.array(
        F.struct(F.lit("transaction_attributes").alias("hint"), attributes.alias("columns"), F.lit(1).alias("at_least")),
        F.struct(F.lit("grain_evidence").alias("hint"), grain.alias("columns"), F.lit(1).alias("at_least")),
    )
    hints = F.concat(F.transform(ids, entity), fixed)
    found = unnest(names, ["dataset_id"], hints, "h").filter(F.size("h.columns") >= F.col("h.at_least"))
    return found.select("dataset_id", "h.hint", "h.columns")


def review_suggestions(payloads: DataFrame, profiles: DataFrame) -> DataFrame:
    """Check machine-suggested mappings, one row per suggestion with every rule it breaks.

    ``payloads`` holds (dataset_id, payload); ``profiles`` (dataset_id, raw_column_name) says which
    columns exist. A payload that cannot be used at all yields one row at position -1.
    """
    # Dealt out first, so that a table in few files is parsed by all tasks.
    doc = payloads.repartition("dataset_id").select(
        "dataset_id",
        contains_any(F.col("payload"), PLAN_SECRET_MARKERS).alias("secret"),
        D.parse(F.col("payload")).alias("doc"),
    ).withColumn("columns", D.items(F.col("doc"), "$.columns"))
    stop = (
        F.when(F.col("secret"), "secret_text")
        .when(F.col("doc").isNull(), "not_json_object")
        .when(F.coalesce(F.size("columns"), F.lit(0)) < 1, "columns_required")
    )
    names = F.transform("columns", lambda c: F.trim(D.text(c, "$.raw_column_name")))
    # A stopped payload has no items, so the outer generator gives it the one row that carries the stop.
    item = doc.withColumns({"stop": stop, "names": names}).select(
        "dataset_id", "stop", "names",
        F.posexplode_outer(F.when(F.col("stop").isNull(), F.col("columns"))).alias("position", "item"),
    )
    i = F.col("item")
    raw = D.safe_text(D.text(i, "$.raw_column_name"), 255, collapse=False)
    suggested = D.safe_text(D.text(i, "$.suggested_name"), 64, collapse=False)
    role = D.safe_text(D.text(i, "$.semantic_role"), 32, collapse=False)
    fields = item.select(
        "dataset_id", "stop", F.coalesce("position", F.lit(-1)).alias("position"),
        D.is_object(i).alias("is_object"),
        raw.alias("raw_column_name"),
        (F.array_position("names", raw) < F.col("position") + 1).alias("repeated"),
        suggested.alias("suggested_name"),
        role.alias("semantic_role"),
        D.number(i, "$.confidence").alias("confidence"),
        F.coalesce(F.try_variant_get(i, "$.needs_review", "boolean"), F.lit(False)).alias("asked_review"),
        D.safe_text(D.text(i, "$.reason"), 512, collapse=False).alias("reason"),
    )
    known = unbroadcast(profiles.select("dataset_id", "raw_column_name", F.lit(True).alias("known")))
    checked = fields.join(known, ["dataset_id", "raw_column_name"], "left")
    c = F.col("confidence")
    broken = F.array_compact(
        F.array(
            F.when(~F.col("is_object"), "not_object"),
            F.when(F.col("known").isNull(), "unknown_column"),
            F.when(F.coalesce("repeated", F.lit(False)), "repeated_column"),
            F.when(~is_safe_name(F.col("suggested_name")), "unsafe_name"),
            F.when(~F.coalesce(F.col("semantic_role").isin(*ROLES), F.lit(False)), "unknown_role"),
            F.when(c.isNull() | (c < 0) | (c > 1), "bad_confidence"),
            F.when(F.col("reason").isNull(), "bad_reason"),
        )
    )
    review = F.col("asked_review") | F.coalesce(c < REVIEW_BELOW, F.lit(False)) | (
        F.coalesce("semantic_role", F.lit("")) == "unknown"
    )
    return checked.select(
        "dataset_id", "position",
        F.coalesce("stop", F.array_join(broken, "|")).alias("violations"), "raw_column_name",
        "suggested_name", "semantic_role", F.round(c, 4).alias("confidence"),
        F.when(F.col("stop").isNull(), review).alias("needs_review"),
    )


def edit_problem(edits: DataFrame) -> DataFrame:
    name, role = strip_all(F.col("approved_name")), strip_all(F.col("approved_role"))
    problem = F.when(~is_safe_name(name), "unsafe_name").when(~role.isin(*ROLES), "unknown_role")
    return edits.withColumns({"approved_name": name, "approved_role": role, "problem": problem})


def apply_edits(mappings: DataFrame, edits: DataFrame) -> DataFrame:
    """Upsert user edits: they override a mapping, or create one with confidence 0. Applying the same edits again changes nothing.

    ``mappings`` may be the result of an earlier call; rows edited then stay marked. A dataset whose edits contain an unusable name or role keeps its mappings as they were.
    """
    checked = edit_problem(edits)
    refused = checked.filter(F.col("problem").isNotNull()).select("dataset_id").distinct()
    usable = checked.join(refused, "dataset_id", "left_anti").select(
        "dataset_id", "column_index",
        F.col("approved_name").alias("new_name"), F.col("approved_role").alias("new_role"),
        F.col("include_in_model").alias("new_include"), F.lit(True).alias("edited"),
    )
    merged = mappings.join(usable, ["dataset_id", "column_index"], "full")
    edited = F.coalesce("edited", F.lit(False))
    before = F.coalesce("user_edited", F.lit(False)) if "user_edited" in mappings.columns else F.lit(False)
    return merged.select(
        "dataset_id", "column_index",
        F.coalesce("suggested_name", "new_name").alias("suggested_name"),
        F.coalesce("semantic_role", "new_role").alias("semantic_role"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(edited, F.col("new_name")).otherwise(F.col("approved_name")).alias("approved_name"),
        F.when(edited, F.col("new_role")).otherwise(F.col("approved_role")).alias("approved_role"),
        F.when(edited, F.col("new_include")).otherwise(F.col("include_in_model")).alias("include_in_model"),
        (edited | before).alias("user_edited"),
    )
