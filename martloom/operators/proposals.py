"""Modelling proposals as JSON: every broken rule as a row, and the spec an accepted one derives.

A proposal is checked inside its own row against the column sets of its dataset, so the only shuffle
is the one that brings the two together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions import documents as D
from martloom.functions.names import is_safe_name
from martloom.functions.text import SPEC_SECRET_MARKERS, contains_any
from martloom.operators.unnest import unbroadcast, unnest

# List and text caps. All entries of a list are judged; what lies beyond its cap is marked. Longer texts are refused.
KEY_ITEMS, MEASURE_ITEMS, DEGENERATE_ITEMS, DATE_ITEMS = 6, 8, 8, 4
DIMENSION_ITEMS, DIMENSION_COLUMNS = 6, 8
MART_ITEMS, MART_DIMENSIONS, MART_METRICS = 4, 3, 4
GRAIN_LENGTH, NAME_LENGTH = 180, 64
DEFAULT_MART_GRAIN = "one row per mart grouping"
# Words every catalog knows.
BASE_TERMS = ("sales", "performance", "trend", "monthly", "month", "compare", "comparison", "breakdown")


LISTS = {
    "keys": KEY_ITEMS, "measures": MEASURE_ITEMS, "degenerate_dimensions": DEGENERATE_ITEMS,
    "date_columns": DATE_ITEMS,
}
PAYLOAD_TYPE = (
    "grain string, fact_table struct<name:string,grain:string,keys:array<string>,measures:array<string>,"
    "degenerate_dimensions:array<string>,date_columns:array<string>>,"
    "dimensions array<struct<name:string,key_column:string,columns:array<string>>>,"
    "marts array<struct<name:string,grain:string,dimensions:array<string>,metrics:array<string>>>"
)


def _texts(values: Column) -> Column:
    """Cleaned and de-duplicated list. Unusable entries stay as NULL for the rule that reports them."""
    return F.coalesce(F.array_distinct(D.safe_texts(values, NAME_LENGTH)), F.array().cast("array<string>"))


def _first(values: Column, cap: int) -> Column:
    """The same list from its first entries only."""
    return _texts(F.slice(values, 1, cap))


def _has_null(values: Column) -> Column:
    return F.exists(values, lambda v: v.isNull())


def _name(value: Column) -> Column:
    return D.safe_text(value, NAME_LENGTH)


def _grain(doc: Column, path: str, value: Column, default: Column) -> Column:
    """Given text if it is usable text, the default where none is given, else NULL."""
    shape = D.kind(doc, path)
    return F.when(shape == "", default).when(shape == "STRING", D.safe_text(value, GRAIN_LENGTH))


def parse(proposals: DataFrame) -> DataFrame:
    """Add the cleaned spec as columns (fact_*, dimensions, marts) and what follows from it: the
    fact's dimension keys, month columns, and the fields a mart may group by as things stand.

    The text is read once into typed fields; ``doc`` only answers what the types cannot, such as
    whether a member was given at all. Each cleaning step is its own projection or transform, so no
    expression is evaluated more than once. Texts are dealt out by dataset first: that is the shuffle of the join that follows, texts are
    smaller than what they are parsed into, and a table in few files is parsed by all tasks.
    """
    read = proposals.repartition("dataset_id").withColumns(
        {"doc": D.parse(F.col("payload")), "given": F.from_json("payload", PAYLOAD_TYPE)}
    )
    doc, given = F.col("doc"), F.col("given")
    fact = given["fact_table"]

    def dimension(d: Column) -> Column:
        return F.struct(
            _name(d["name"]).alias("name"), _name(d["key_column"]).alias("key_column"),
            _texts(d["columns"]).alias("columns"), _first(d["columns"], DIMENSION_COLUMNS).alias("first_columns"),
            d["columns"].isNotNull().alias("columns_given"), (F.size(d["columns"]) > DIMENSION_COLUMNS).alias("long"),
        )

    def keyed(d: Column) -> Column:
        """The key comes first where the columns leave it out."""

        def with_key(name: str) -> Column:
            missing = ~F.array_contains(d[name], d["key_column"])
            return F.when(
                d["key_column"].isNotNull() & F.coalesce(missing, F.lit(True)), F.concat(F.array(d["key_column"]), d[name])
            ).otherwise(d[name])

        return F.struct(
            d["name"].alias("name"), d["key_column"].alias("key_column"), with_key("columns").alias("columns"),
            with_key("first_columns").alias("first_columns"), d["columns_given"].alias("columns_given"), d["long"].alias("long"),
        )

    mart_shapes = F.transform(D.items(doc, "$.marts"), lambda m: D.kind(m, "$.grain"))

    def mart(m: Column, i: Column) -> Column:
        shape = F.get(F.col("mart_shapes"), i)
        return F.struct(
            _name(m["name"]).alias("name"),
            F.when(shape == "", F.lit(DEFAULT_MART_GRAIN))
            .when(shape == "STRING", D.safe_text(m["grain"], GRAIN_LENGTH))
            .alias("grain"),
            _texts(m["dimensions"]).alias("dimensions"), _first(m["dimensions"], MART_DIMENSIONS).alias("first_dimensions"),
            _texts(m["metrics"]).alias("metrics"), _first(m["metrics"], MART_METRICS).alias("first_metrics"),
            (F.size(m["dimensions"]) > MART_DIMENSIONS).alias("long_dimensions"),
            (F.size(m["metrics"]) > MART_METRICS).alias("long_metrics"),
        )

    cleaned = read.withColumns(
        {
            "mart_shapes": mart_shapes,
            "grain": _grain(doc, "$.grain", given["grain"], F.lit(None).cast("string")),
            "dims": F.transform(given["dimensions"], dimension),
        }
    )
    shaped = cleaned.select(
        *proposals.columns, "doc", "grain",
        _name(fact["name"]).alias("fact_name"),
        _grain(doc, "$.fact_table.grain", fact["grain"], F.col("grain")).alias("fact_grain"),
        *(_texts(fact[n]).alias(f"fact_{n}") for n in LISTS),
        *(_first(fact[n], cap).alias(f"first_{n}") for n, cap in LISTS.items()),
        F.array_compact(F.array(*(F.when(F.size(fact[n]) > cap, F.lit(f"fact_table.{n}")) for n, cap in LISTS.items()))).alias("long_lists"),
        F.coalesce(F.transform("dims", keyed), F.array()).alias("dimensions"),
        F.coalesce(F.transform(given["marts"], mart), F.array()).alias("marts"),
    )
    keys = F.array_distinct(F.concat("fact_keys", F.transform("dimensions", lambda d: d["key_column"])))
    months = F.transform("fact_date_columns", lambda c: F.concat(c, F.lit("_month")))
    held = F.flatten(F.transform("dimensions", lambda d: d["columns"]))
    return shaped.withColumns({"fact_dimension_keys": keys, "fact_months": months}).withColumn(
        "candidates",
        F.array_distinct(
            F.concat(
                "fact_dimension_keys", "fact_degenerate_dimensions", held, "fact_date_columns", "fact_months"
            )
        ),
    )


def _listed(doc: Column, path: str) -> Column:
    """A list where one is given at all."""
    return (D.kind(doc, path) == "") | D.is_list(doc, path)


def _outside(values: Column, allowed: str) -> Column:
    return F.size(F.array_except(values, F.col(allowed))) > 0


def checked(proposals: DataFrame, column_sets: DataFrame) -> DataFrame:
    """Parsed proposals with ``broken``: the (rule, subject) pairs in checking order."""
    joined = parse(proposals).join(unbroadcast(column_sets), "dataset_id", "left")
    doc, dims, marts = F.col("doc"), F.col("dimensions"), F.col("marts")

    def rule(name: str, broken: Column, subject: Column | None = None, within: Column | bool = True) -> Column:
        """``within``: whether it is broken as well when lists are cut at their caps."""
        at = F.lit("") if subject is None else F.coalesce(subject, F.lit(""))
        near = F.lit(within) if isinstance(within, bool) else F.coalesce(within, F.lit(False))
        return F.when(
            F.coalesce(broken, F.lit(False)),
            F.struct(F.lit(name).alias("rule"), at.alias("subject"), near.alias("within_limit")),
        )

    def first(n: str) -> Column:
        return F.col(f"first_{n}")

    head = [
        rule("grain_text", F.col("grain").isNull()),
        rule("fact_missing", ~D.is_object(doc, "$.fact_table")),
        rule("fact_name", ~(is_safe_name(F.col("fact_name")) & F.startswith("fact_name", F.lit("fact_")))),
        rule("fact_grain", F.col("fact_grain").isNull()),
        *(
            rule(
                f"fact_{n}_list", ~_listed(doc, f"$.fact_table.{n}") | _has_null(F.col(f"fact_{n}")),
                within=~_listed(doc, f"$.fact_table.{n}") | _has_null(first(n)),
            )
            for n in LISTS
        ),
        *(
            rule(
                f"fact_{n}_unknown", _outside(F.array_compact(f"fact_{n}"), "all_columns"),
                within=_outside(F.array_compact(first(n)), "all_columns"),
            )
            for n in LISTS
        ),
        rule(
            "fact_measures_numeric", (F.size("fact_measures") == 0) | _outside(F.col("fact_measures"), "measures"),
            within=(F.size("fact_measures") == 0) | _outside(first("measures"), "measures"),
        ),
        rule(
            "fact_degenerate_labels", _outside(F.col("fact_degenerate_dimensions"), "label_columns"),
            within=_outside(first("degenerate_dimensions"), "label_columns"),
        ),
        rule("fact_dates", _outside(F.col("fact_date_columns"), "dates"), within=_outside(first("date_columns"), "dates")),
        rule("dimensions_required", F.size(dims) < 1),
    ]
    dim_names = F.transform(dims, lambda d: d["name"])

    def dimension_rules(d: Column, i: Column) -> Column:
        name, near = d["name"], i < DIMENSION_ITEMS
        holds = lambda columns: F.exists(
            columns, lambda c: F.array_contains(F.col("measures"), c) & (c != d["key_column"])
        )
        return F.array(
            rule("dimension_name", ~(is_safe_name(name) & F.startswith(name, F.lit("dim_"))), name, near),
            rule("dimension_repeated", F.array_position(dim_names, name) < i + 1, name, near),
            rule("dimension_key", ~is_safe_name(d["key_column"]), name, near),
            rule(
                "dimension_columns_list", ~d["columns_given"] | _has_null(d["columns"]), name,
                near & (~d["columns_given"] | _has_null(d["first_columns"])),
            ),
            rule(
                "dimension_unknown_columns", _outside(F.array_compact(d["columns"]), "all_columns"), name,
                near & _outside(F.array_compact(d["first_columns"]), "all_columns"),
            ),
            rule("dimension_holds_measure", holds(d["columns"]), name, near & holds(d["first_columns"])),
            rule(
                "dimension_key_role",
                ~F.array_contains(F.col("label_columns"), d["key_column"])
                & ~F.array_contains(F.col("identifiers"), d["key_column"]),
                name, near,
            ),
            rule("list_too_long", d["long"], F.concat(name, F.lit(".columns")), False),
        )

    mart_names = F.transform(marts, lambda m: m["name"])

    def mart_rules(m: Column, i: Column) -> Column:
        name, near = m["name"], i < MART_ITEMS
        loose = lambda columns: F.exists(
            columns,
            lambda c: ~F.array_contains(F.col("candidates"), c)
            & ~(F.array_contains(F.col("label_columns"), c) & ~F.array_contains(F.col("measures"), c)),
        )
        foreign = lambda metrics: F.size(F.array_except(metrics, F.col("fact_measures"))) > 0
        return F.array(
            rule("mart_name", ~(is_safe_name(name) & F.startswith(name, F.lit("mart_"))), name, near),
            rule("mart_repeated", F.array_position(mart_names, name) < i + 1, name, near),
            rule("mart_grain", m["grain"].isNull(), name, near),
            rule(
                "mart_lists", _has_null(m["dimensions"]) | _has_null(m["metrics"]), name,
                near & (_has_null(m["first_dimensions"]) | _has_null(m["first_metrics"])),
            ),
            rule("mart_dimensions_required", F.size(m["dimensions"]) == 0, name, near),
            rule("mart_metrics_required", F.size(m["metrics"]) == 0, name, near),
            rule("mart_unknown_dimension", loose(m["dimensions"]), name, near & loose(m["first_dimensions"])),
            rule("mart_metric_not_in_fact", foreign(m["metrics"]), name, near & foreign(m["first_metrics"])),
            rule("list_too_long", m["long_dimensions"], F.concat(name, F.lit(".dimensions")), False),
            rule("list_too_long", m["long_metrics"], F.concat(name, F.lit(".metrics")), False),
        )

    body = F.concat(
        F.array(*head),
        F.flatten(F.transform(dims, dimension_rules)),
        F.array(rule("marts_required", F.size(marts) < 1)),
        F.flatten(F.transform(marts, mart_rules)),
        F.transform("long_lists", lambda path: rule("list_too_long", F.lit(True), path, False)),
        F.array(
            rule("list_too_long", F.size(dims) > DIMENSION_ITEMS, F.lit("dimensions"), False),
            rule("list_too_long", F.size(marts) > MART_ITEMS, F.lit("marts"), False),
        ),
    )
    found = (
        F.when(contains_any(F.col("payload"), SPEC_SECRET_MARKERS), F.array(rule("secret_text", F.lit(True))))
        .when(doc.isNull(), F.array(rule("not_json_object", F.lit(True))))
        .when(F.col("all_columns").isNull(), F.array(rule("no_mapped_columns", F.lit(True))))
        .otherwise(body)
    )
    return joined.withColumn("broken", F.array_compact(found))


def violations(proposals: DataFrame, column_sets: DataFrame) -> DataFrame:
    """One row per broken rule: (proposal_id, position, rule, subject, within_limit).

    Rules appear in checking order, so position 0 is the error a stop-at-first check would raise.
    ``subject`` is the dimension, mart or list at fault, empty for the fact and the proposal itself. Where ``within_limit`` is false,
    the rule is broken only by entries beyond a list's cap, or by the length itself.
    """
    rows = unnest(checked(proposals, column_sets), ["proposal_id"], "broken", "v", "position")
    return rows.select("proposal_id", "position", "v.rule", "v.subject", "v.within_limit")


def accepted(proposals: DataFrame, column_sets: DataFrame) -> DataFrame:
    """Parsed proposals that break no rule."""
    return checked(proposals, column_sets).filter(F.size("broken") == 0).drop("broken")


def candidate_fields(specs: DataFrame) -> DataFrame:
    return unnest(specs, ["proposal_id"], "candidates", "field")


def derived(specs: DataFrame) -> DataFrame:
    """What follows from an accepted spec: the fact's dimension keys, its degenerate dimensions with
    those only marts mention, and the resulting column list."""
    mart_fields = F.flatten(F.transform("marts", lambda m: m["dimensions"]))
    degenerate = F.array_distinct(
        F.concat("fact_degenerate_dimensions", F.array_except(mart_fields, F.col("candidates")))
    )
    columns = F.array_distinct(
        F.concat(
            "fact_keys", "fact_dimension_keys", "fact_degenerate_dimensions", "fact_date_columns",
            "fact_months", "fact_measures",
        )
    )
    return specs.withColumn("fact_degenerate_dimensions", degenerate).select(
        "proposal_id", "fact_dimension_keys", "fact_degenerate_dimensions", columns.alias("fact_columns")
    )


def catalog(specs: DataFrame) -> DataFrame:
    """Marts of each spec with their grain, dimensions and metrics."""
    return unnest(specs, ["proposal_id"], "marts", "m").select(
        "proposal_id", F.col("m.name").alias("mart"), "m.grain", "m.dimensions", "m.metrics"
    )


def unknown_columns(specs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Referenced columns the dataset does not map, by an anti-join on (dataset, column)."""
    parts = [("fact_table." + n, F.col(f"fact_{n}")) for n in LISTS]
    from_fact = F.array(*(F.struct(F.lit(p).alias("used_in"), F.array_compact(c).alias("columns")) for p, c in parts))
    from_dims = F.transform(
        "dimensions",
        lambda d: F.struct(d["name"].alias("used_in"), F.array_compact(d["columns"]).alias("columns")),
    )
    places = unnest(specs, ["proposal_id", "dataset_id"], F.concat(from_fact, from_dims), "place")
    used = places.select(
        "proposal_id", "dataset_id", F.col("place.used_in").alias("used_in"),
        F.explode("place.columns").alias("name"),
    )
    return used.join(unbroadcast(mappings.select("dataset_id", "name")), ["dataset_id", "name"], "left_anti").select(
        "proposal_id", "used_in", F.col("name").alias("column_name")
    )


def catalog_terms(catalog_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Words a suggested question may refer to: base words, mart names, fields and their parts."""
    lowered = F.transform(F.concat("metrics", "dimensions"), F.lower)
    parts = F.flatten(F.transform(lowered, lambda f: F.split(f, "_")))
    words = F.concat(
        F.array(*(F.lit(w) for w in BASE_TERMS)), F.array(F.lower("mart")), lowered,
        F.filter(parts, lambda p: p != ""),
    )
    return unnest(catalog_rows, keys, F.array_distinct(words), "term").distinct()
