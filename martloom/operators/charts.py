"""Charts for stored results: which chart fits, its spec, checks of a given spec, series values.

``results`` holds run_id, question, intent, source_model, grain, metrics and dimensions (names),
output_schema (name, type) and preview_rows (field to text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions import cleaning as C
from martloom.functions import documents as D
from martloom.functions.text import SECRET_MARKERS, contains_any
from martloom.operators.unnest import unnest

# Type-name and field-name hints, ranking words, chart types, rows shown per table.
NUMERIC_TYPES = "number|numeric|decimal|fixed|float|double|real|int"
TIME_WORDS = "date|time|timestamp|month|year"
RANKING_WORDS = "top|rank|ranking|highest|best|lowest"
CHART_TYPES = ("kpi", "line", "bar", "horizontal_bar", "table")
AXIS_CHARTS = ("line", "bar", "horizontal_bar")
TABLE_ROWS, COMPACT_TABLE_ROWS = 10, 3


def with_field_kinds(results: DataFrame) -> DataFrame:
    """Add ``fields``: name, lookup key, whether numeric and whether time-like."""

    def kind(f: Column) -> Column:
        type_name, key = F.lower(F.coalesce(f["type"], F.lit(""))), F.lower(f["name"])
        by_value = F.exists(
            F.col("preview_rows"),
            lambda row: F.coalesce(C.is_number_text(F.try_element_at(row, f["name"])), F.lit(False)),
        )
        return F.struct(
            f["name"].alias("name"), key.alias("key"),
            (type_name.rlike(NUMERIC_TYPES) | by_value).alias("is_numeric"),
            (type_name.rlike(TIME_WORDS) | key.rlike(TIME_WORDS)).alias("is_time"),
        )

    named = F.filter("output_schema", lambda f: F.coalesce(f["name"], F.lit("")) != "")
    return results.withColumn("fields", F.transform(named, kind))


def field_kinds(results: DataFrame) -> DataFrame:
    rows = unnest(with_field_kinds(results), ["run_id"], "fields", "f")
    return rows.select("run_id", F.col("f.name").alias("field"), "f.is_numeric", "f.is_time")


def _first(names: str, numeric: bool) -> Column:
    """First listed name that is a result field, looked up without regard to case."""
    hits = F.flatten(
        F.transform(
            F.coalesce(names, F.array().cast("array<string>")),
            lambda n: F.filter(
                "fields", lambda f: (f["key"] == F.lower(n)) & (f["is_numeric"] if numeric else F.lit(True))
            ),
        )
    )
    return F.get(hits, 0)


def choose(results: DataFrame) -> DataFrame:
    """Add chart_type, title, the two fields behind it, and the chart spec as JSON."""
    picked = with_field_kinds(results).withColumns(
        {"metric": _first("metrics", True), "dimension": _first("dimensions", False)}
    )
    metric, dimension = F.col("metric.name"), F.col("dimension.name")
    text = F.lower(F.concat_ws(" ", "question", F.coalesce("intent", F.lit(""))))
    both = metric.isNotNull() & dimension.isNotNull()
    chart_type = (
        F.when((F.size("preview_rows") == 1) & metric.isNotNull() & dimension.isNull(), "kpi")
        .when(both & F.col("dimension.is_time"), "line")
        .when(both & text.rlike(RANKING_WORDS), "horizontal_bar")
        .when(both, "bar")
        .otherwise("table")
    )
    label, dimension_label = C.humanize(metric), C.humanize(dimension)
    typed = picked.filter(F.size("fields") > 0).withColumns(
        {"chart_type": chart_type, "metric_field": metric, "dimension_field": dimension}
    )
    kind = F.col("chart_type")
    title = (
        F.when(kind == "kpi", label)
        .when(kind == "line", F.concat(label, F.lit(" Trend")))
        .when(kind == "table", F.lit("Analysis Result"))
        .otherwise(F.concat(label, F.lit(" by "), dimension_label))
    )
    titled = typed.withColumn("title", title)
    value = F.struct(metric.alias("field"), label.alias("label"), C.format_hint(metric).alias("format"))
    x = F.struct(
        dimension.alias("field"), dimension_label.alias("label"),
        F.when(kind == "line", "time").otherwise("category").alias("semantic_type"),
    )
    columns = F.transform(
        "fields", lambda f: F.struct(f["name"].alias("field"), C.humanize(f["name"]).alias("label"))
    )
    tags = (
        F.when(kind == "kpi", F.array(F.lower(metric), F.lit("kpi")))
        .when(kind == "table", F.array(F.lit("table")))
        .otherwise(F.array(F.when(kind == "line", "trend").otherwise("breakdown"), F.lower(metric)))
    )
    spec = F.to_json(
        F.struct(
            kind.alias("type"), "title",
            F.when(kind == "kpi", value).alias("value"),
            F.when(kind.isin(*AXIS_CHARTS), x).alias("x"),
            F.when(kind.isin(*AXIS_CHARTS), value).alias("y"),
            F.when(kind == "table", columns).alias("columns"),
            "source_model", "grain", tags.alias("tags"),
        )
    )
    return titled.withColumn("chart_spec", spec)


SPEC_TYPE = (
    "type string, source_model string, value struct<field:string>, x struct<field:string>, "
    "y struct<field:string>, columns array<struct<field:string>>"
)


def violations(charts: DataFrame) -> DataFrame:
    """Rules a given chart spec breaks against its result, one row each.

    ``charts`` is a result with ``chart_spec`` (JSON text) next to it.
    """
    read = with_field_kinds(charts).withColumn("given", F.from_json("chart_spec", SPEC_TYPE))
    kind = F.col("given.type")
    axis = kind.isin(*AXIS_CHARTS)
    referenced = F.array_compact(
        F.when(kind == "kpi", F.array("given.value.field"))
        .when(axis, F.array("given.x.field", "given.y.field"))
        .when(kind == "table", F.transform("given.columns", lambda c: c["field"]))
        .otherwise(F.array().cast("array<string>"))
    )
    parts = read.select(
        "run_id", "chart_spec", "source_model", "preview_rows", "fields", "given", kind.alias("kind"),
        F.filter(F.coalesce(referenced, F.array().cast("array<string>")), lambda f: f != "").alias("referenced"),
    )
    names = F.transform("fields", lambda f: f["name"])

    def is_kind(field: str, flag: str) -> Column:
        """Lookup is case-insensitive; a field the result lacks is judged by its own name only."""
        found = F.exists("fields", lambda f: (f["key"] == F.lower(F.col(field))) & f[flag])
        by_name = F.lower(field).rlike(TIME_WORDS) if flag == "is_time" else F.lit(False)
        return F.coalesce(found | by_name, F.lit(False))

    rule = lambda name, broken: F.when(F.coalesce(broken, F.lit(False)), F.lit(name))
    supported = F.coalesce(F.col("kind").isin(*CHART_TYPES), F.lit(False))
    axes = F.col("kind").isin(*AXIS_CHARTS)
    has_axes = F.col("given.x.field").isNotNull() & F.col("given.y.field").isNotNull()
    rules = [
        rule("unsupported_type", ~supported),
        rule("plotly_config", F.contains(F.lower("chart_spec"), F.lit("plotly"))),
        rule("unknown_source_model", F.col("given.source_model") != F.nullif("source_model", F.lit(""))),
        rule("secret_text", contains_any(F.concat(F.col("chart_spec"), F.to_json("preview_rows")), SECRET_MARKERS)),
        rule("no_fields", supported & (F.size("referenced") == 0)),
        rule("fields_outside_schema", F.size(F.array_except("referenced", names)) > 0),
        rule("kpi_not_numeric", (F.col("kind") == "kpi") & ~is_kind("given.value.field", "is_numeric")),
        rule("axes_required", axes & ~has_axes),
        rule("y_not_numeric", axes & has_axes & ~is_kind("given.y.field", "is_numeric")),
        rule("line_x_not_time", (F.col("kind") == "line") & has_axes & ~is_kind("given.x.field", "is_time")),
        rule(
            "bar_x_numeric",
            F.col("kind").isin("bar", "horizontal_bar") & has_axes & is_kind("given.x.field", "is_numeric"),
        ),
    ]
    return unnest(parts, ["run_id"], F.array_compact(F.array(*rules)), "rule", "position")


def series(charts: DataFrame, compact: bool = False) -> DataFrame:
    """Chart points: the measure as a number where it reads as one, its text otherwise.

    ``within_limit`` is false for rows that a table, which shows its first rows only, leaves off.
    """
    cap = COMPACT_TABLE_ROWS if compact else TABLE_ROWS
    rows = unnest(
        charts, ["run_id", "chart_type", "metric_field", "dimension_field"], "preview_rows", "row", "position"
    )
    text = F.try_element_at("row", F.col("metric_field"))
    return rows.select(
        "run_id", "chart_type", "position",
        F.try_element_at("row", F.col("dimension_field")).alias("x"), C.to_number(text).alias("y"), text.alias("y_text"),
        ((F.col("chart_type") != "table") | (F.col("position") < cap)).alias("within_limit"),
    )
