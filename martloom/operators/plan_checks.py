"""Analysis plans as JSON, checked against the catalog of marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from martloom.functions import documents as D
from martloom.functions.names import SAFE_NAME, strip_all
from martloom.functions.text import PLAN_SECRET_MARKERS, contains_any
from martloom.operators.unnest import unnest
from martloom.plans.analysis import AGGREGATIONS, MAX_LIMIT, AnalysisPlan, Filter

# Decisions, filter operators and directions a plan may name.
DECISIONS = ("create_new", "needs_user_confirmation")
OPERATORS = ("=", "!=")
DIRECTIONS = ("asc", "desc")
PAYLOAD_TYPE = (
    "decision_type string, question string, intent string, source_model string, grain string, "
    "metrics array<struct<name:string,aggregation:string>>, dimensions array<string>, "
    "filters array<struct<field:string,operator:string,value:variant>>, "
    "sort array<struct<field:string,direction:string>>, limit variant"
)


def _list_ok(doc: Column, path: str) -> Column:
    return (D.kind(doc, path) == "") | D.is_list(doc, path)


def _text(doc: Column, path: str, value: Column, cap: int) -> Column:
    return F.when(D.is_text(doc, path), D.safe_text(value, cap, collapse=False))


def checked(plans: DataFrame, catalog: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Plans with their cleaned parts and ``broken``, the rules they break in checking order.

    ``catalog`` holds (mart, grain, dimensions, metrics) and is joined on the mart a plan names, plus
    ``keys`` where catalogs differ per dataset. Two rules go beyond a plain membership check: a sort
    field must be part of the result, and a metric may be asked for once, since it names its column.
    """
    keys = keys or []
    # Dealt out first, so that a table in few files is parsed by all tasks; equal ids or texts alone do not meet.
    read = plans.repartition("plan_id", "payload").withColumns({"doc": D.parse(F.col("payload")), "given": F.from_json("payload", PAYLOAD_TYPE)})
    doc, given = F.col("doc"), F.col("given")
    parts = read.select(
        *plans.columns, "doc",
        _text(doc, "$.decision_type", given["decision_type"], 64).alias("decision_type"),
        _text(doc, "$.question", given["question"], 500).alias("question"),
        _text(doc, "$.intent", given["intent"], 128).alias("intent"),
        _text(doc, "$.source_model", given["source_model"], 128).alias("source_model"),
        _text(doc, "$.grain", given["grain"], 255).alias("plan_grain"),
        F.transform(
            given["metrics"],
            lambda m: F.struct(
                strip_all(m["name"]).alias("name"), F.lower(strip_all(m["aggregation"])).alias("aggregation")
            ),
        ).alias("plan_metrics"),
        F.array_distinct(
            F.coalesce(F.transform(given["dimensions"], strip_all), F.array())
        ).alias("plan_dimensions"),
        F.coalesce(given["filters"], F.array()).alias("filters"),
        F.coalesce(
            F.transform(
                given["sort"],
                lambda s: F.struct(
                    strip_all(s["field"]).alias("field"),
                    F.lower(strip_all(F.coalesce(s["direction"], F.lit("asc")))).alias("direction"),
                ),
            ),
            F.array(),
        ).alias("sort"),
        F.when(D.is_integer(doc, "$.limit"), F.try_variant_get(given["limit"], "$", "bigint")).alias("row_limit"),
    )
    known = catalog.withColumnRenamed("mart", "source_model")
    joined = parts.join(known, [*keys, "source_model"], "left")
    in_catalog = F.col("metrics").isNotNull()
    names = F.transform("plan_metrics", lambda m: m["name"])
    selected = F.concat("plan_dimensions", names)
    fields = F.concat("dimensions", "metrics")

    def rule(name: str, broken: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.lit(name))

    outside = lambda value, allowed: ~F.coalesce(value.isin(*allowed), F.lit(False))
    unknown = lambda value, allowed: ~F.coalesce(F.array_contains(allowed, value), F.lit(False))
    no_metrics = F.coalesce(F.size("plan_metrics"), F.lit(0)) < 1
    rules = [
        rule("contains_sql", (D.kind(doc, "$.sql") != "") | (D.kind(doc, "$.generated_sql") != "")),
        rule("decision_type", outside(F.col("decision_type"), DECISIONS)),
        rule("needs_confirmation", F.col("decision_type") == "needs_user_confirmation"),
        rule("unknown_model", ~in_catalog),
        rule("metrics_required", no_metrics),
        rule("metric_name", in_catalog & F.exists(names, lambda n: unknown(n, F.col("metrics")))),
        rule("metric_aggregation", F.exists("plan_metrics", lambda m: outside(m["aggregation"], AGGREGATIONS))),
        rule("dimensions_list", ~_list_ok(doc, "$.dimensions")),
        rule("dimension_name", in_catalog & F.exists("plan_dimensions", lambda d: unknown(d, F.col("dimensions")))),
        rule("filters_list", ~_list_ok(doc, "$.filters")),
        rule("filter_field", in_catalog & F.exists("filters", lambda f: unknown(strip_all(f["field"]), F.col("dimensions")))),
        rule("filter_operator", F.exists("filters", lambda f: outside(F.coalesce(f["operator"], F.lit("=")), OPERATORS))),
        rule("filter_value", F.exists("filters", lambda f: F.schema_of_variant(f["value"]).rlike("^(OBJECT|ARRAY)"))),
        rule("sort_list", ~_list_ok(doc, "$.sort")),
        rule("sort_field", in_catalog & F.exists("sort", lambda s: unknown(s["field"], fields))),
        rule("sort_direction", F.exists("sort", lambda s: outside(s["direction"], DIRECTIONS))),
        rule("limit_integer", ~D.is_missing(doc, "$.limit") & F.col("row_limit").isNull()),
        rule("limit_range", (F.col("row_limit") < 1) | (F.col("row_limit") > MAX_LIMIT)),
        rule("question_text", F.col("question").isNull()),
        rule("intent_name", ~D.is_missing(doc, "$.intent") & ~F.coalesce(F.col("intent").rlike(SAFE_NAME), F.lit(False))),
        rule("grain_text", (D.kind(doc, "$.grain") != "") & F.col("plan_grain").isNull()),
        rule("sort_not_selected", in_catalog & F.exists("sort", lambda s: F.array_contains(fields, s["field"]) & unknown(s["field"], selected))),
        rule("metric_repeated", F.size(F.array_distinct(names)) < F.size(names)),
    ]
    found = (
        F.when(contains_any(F.col("payload"), PLAN_SECRET_MARKERS), F.array(F.lit("secret_text")))
        .when(doc.isNull(), F.array(F.lit("not_json_object")))
        .otherwise(F.array_compact(F.array(*rules)))
    )
    return joined.withColumns(
        {
            "broken": found,
            "result_grain": F.coalesce("plan_grain", "grain"),
        }
    )


def violations(plans: DataFrame, catalog: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per plan and broken rule; position 0 is where a stop-at-first check would end."""
    return unnest(checked(plans, catalog, keys), ["plan_id"], "broken", "rule", "position")


def accepted(plans: DataFrame, catalog: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Plans without violations, cleaned. A plan without a limit returns all of its groups."""
    good = checked(plans, catalog, keys).filter(F.size("broken") == 0)
    value = lambda f: F.struct(
        strip_all(f["field"]).alias("field"), F.coalesce(f["operator"], F.lit("=")).alias("operator"),
        F.to_json(f["value"]).alias("value"),
    )
    return good.select(
        *(c for c in plans.columns if c != "payload"), "question", "intent", "source_model", "result_grain",
        F.col("plan_metrics").alias("metrics"), F.col("plan_dimensions").alias("dimensions"),
        F.transform("filters", value).alias("filters"), "sort", "row_limit",
    )


def to_plan(row: Row) -> AnalysisPlan:
    """One accepted plan row as a plan that ``run_plan`` takes."""
    import json

    return AnalysisPlan(
        source_model=row["source_model"],
        metrics=tuple((m["name"], m["aggregation"]) for m in row["metrics"]),
        dimensions=tuple(row["dimensions"]),
        filters=tuple(
            Filter(f["field"], f["operator"], None if f["value"] is None else json.loads(f["value"]))
            for f in row["filters"]
        ),
        sort=tuple((s["field"], s["direction"]) for s in row["sort"]),
        limit=row["row_limit"],
    )
