"""Many analysis plans at once.

Plans that ask the same are one. Each mart is read once: it is grouped by every set of fields that some plan groups or filters by, in one
``GROUPING SETS`` pass, and plans meet the groups of their set by a join. Filters are applied to these groups, which are then put together
along the plan's own dimensions. So the mart's rows are aggregated as often as there are sets of its dimensions, whatever
the number of plans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.plans.analysis import MAX_LIMIT
from martloom.session import copied

ASKED = ("source_model", "metrics", "dimensions", "filters", "sort", "row_limit")
EXACT = "decimal(38,6)"


def _literal(item: Column, kind: T.DataType) -> Column:
    """A filter's JSON value as text in the spelling of the field's type; NULL where it is none of that type."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), F.coalesce(item["value"], F.lit("null")), F.lit("}")), "$.v")
    return text.try_cast(kind).cast("string")


def _keeps(item: Column, group: Column, types: dict[str, T.DataType]) -> Column:
    """One filter on a group's fields. NULL on either side keeps nothing, for != neither."""
    wanted = reduce(lambda found, f: found.when(item["field"] == f, _literal(item, types[f])), types, F.when(F.lit(False), F.lit("")))
    have = group[item["field"]]
    return F.coalesce(F.when(item["operator"] == "=", have == wanted).otherwise(have != wanted), F.lit(False))


def _parts(mart: DataFrame, fields: list[str], metrics: list[str], sets: list[list[str]]) -> DataFrame:
    """(set, group, metric, rows, sum, least, most): one row per group of each set and metric. Sums keep what the metric's type is exact in."""
    types = {f.name: f.dataType for f in mart.schema.fields}

    def part(name: str) -> Column:
        exact = not isinstance(types[name], (T.DoubleType, T.FloatType))
        col = F.col(name).try_cast(EXACT) if exact else F.col(name).cast("double")
        total = F.try_sum(col)
        none = F.lit(None).cast("double") if exact else F.lit(None).cast(EXACT)
        return F.struct(
            F.lit(name).alias("metric"), F.count(name).alias("rows"), (total.cast(EXACT) if exact else none).alias("exact"),
            (none if exact else total).alias("loose"), F.min(col).cast("double").alias("least"), F.max(col).cast("double").alias("most"),
        )

    grouped = mart.groupingSets([[F.col(f) for f in s] for s in sets], *(F.col(f) for f in fields)) if fields else mart.groupBy()
    used = [F.when(F.grouping(f) == 0, F.lit(f)) for f in fields]
    rows = grouped.agg(
        F.array_compact(F.array(*used)).alias("__used") if used else F.array().cast("array<string>").alias("__used"), F.array(*map(part, metrics)).alias("__parts"),
    )
    # A field outside of a row's set is NULL there; the set tells such a NULL from one of the mart.
    group = F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string")))) if fields else F.create_map().cast("map<string,string>")
    return rows.select(F.array_sort("__used").alias("__set"), group.alias("__group"), F.inline("__parts"))


def distinct_plans(plans: DataFrame) -> DataFrame:
    """``plans`` with ``plan_key``, equal for plans that ask the same."""
    return plans.withColumn("plan_key", F.sha2(F.to_json(F.struct(*ASKED)), 256))


def kept(plans: DataFrame) -> DataFrame:
    """``plans`` as a copy in the shared folder, for plans that are checked on the way and read more than once."""
    return copied(plans, "plans")


def run_batch(plans: DataFrame, marts: dict[str, DataFrame], catalog: dict[str, dict]) -> DataFrame:
    """The results of accepted plans (``plan_checks.accepted``), as rows of ``plan_key``, ``position``, ``members``, ``metric`` and ``value``.

    ``members`` are the group's values in the order of the plan's dimensions, as text; ``value`` is a double. ``position`` counts a
    plan's groups from 0 in the order it asks for, groups settling ties. Only plans with a limit have positions, of which none has
    more than the largest limit allowed; the others return all groups with NULL there, in no order. A plan without dimensions has one
    row, also where its filters keep nothing. Use :func:`distinct_plans` to come from ``plan_key`` to plans.
    """
    asked = distinct_plans(plans).dropDuplicates(["plan_key"]).select("plan_key", *ASKED)
    asked = asked.withColumn("__set", F.array_sort(F.array_union("dimensions", F.transform("filters", lambda f: f["field"]))))
    # Every mart reads the distinct plans, which may take long to check and are short once they are.
    asked = kept(asked)
    # At most one set for each subset of a catalog's dimensions.
    sets: dict[str, list[list[str]]] = {}
    for row in asked.select("source_model", "__set").distinct().orderBy("source_model", "__set").collect():
        sets.setdefault(row["source_model"], []).append(row["__set"])
    results = [_of_mart(asked, name, marts[name], catalog[name], found) for name, found in sets.items() if name in marts]
    if not results:
        kinds = {"plan_key": "string", "position": "long", "members": "array<string>", "metric": "string", "value": "double"}
        return plans.sparkSession.range(0).select(*(F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    return reduce(DataFrame.unionByName, results)


def _of_mart(asked: DataFrame, name: str, mart: DataFrame, known: dict, sets: list[list[str]]) -> DataFrame:
    fields = sorted({f for s in sets for f in s})
    types = {f: mart.schema[f].dataType for f in fields}
    parts = _parts(mart, fields, known["metrics"], sets)
    mine = asked.filter(F.col("source_model") == name)
    wanted = mine.select("plan_key", "__set", "dimensions", "filters", F.posexplode("metrics").alias("__at", "__metric"))
    wanted = wanted.select("plan_key", "__set", "dimensions", "filters", "__at", F.col("__metric.name").alias("metric"), F.col("__metric.aggregation").alias("__how"))
    kept = wanted.join(parts, ["__set", "metric"]).filter(F.forall("filters", lambda f: _keeps(f, F.col("__group"), types)))
    members = F.transform("dimensions", lambda d: F.col("__group")[d])
    # A plan without dimensions keeps a row of its own for the case that no group is left.
    none = wanted.filter(F.size("dimensions") == 0).select(
        "plan_key", "__at", "metric", "__how", F.array().cast("array<string>").alias("members"), F.lit(0).cast("long").alias("rows"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("exact", EXACT), ("loose", "double"), ("least", "double"), ("most", "double"))),
    )
    rows = kept.select("plan_key", "__at", "metric", "__how", members.alias("members"), "rows", "exact", "loose", "least", "most").unionByName(none)
    totals = rows.groupBy("plan_key", "__at", "metric", "__how", "members").agg(
        F.sum("rows").alias("rows"), F.try_sum("exact").alias("exact"), F.sum("loose").alias("loose"), F.min("least").alias("least"), F.max("most").alias("most"),
    )
    total = F.coalesce(F.col("exact").cast("double"), F.col("loose"))
    value = (
        F.when(F.col("__how") == "count", F.col("rows").cast("double")).when(F.col("__how") == "sum", total)
        .when(F.col("__how") == "avg", total / F.nullif("rows", F.lit(0))).when(F.col("__how") == "min", F.col("least")).otherwise(F.col("most"))
    )
    # One row per group again; a plan's metrics are few, since each may be named once.
    groups = totals.groupBy("plan_key", "members").agg(F.sort_array(F.collect_list(F.struct("__at", "metric", value.alias("value")))).alias("__values"))
    rest = mine.select("plan_key", "dimensions", "sort", "row_limit")
    found = groups.join(rest, "plan_key")
    shown = _first(found, types, known)
    return shown.select("plan_key", "position", "members", F.inline("__values")).select("plan_key", "position", "members", "metric", "value")


def _first(groups: DataFrame, types: dict[str, T.DataType], known: dict) -> DataFrame:
    """Groups within the plans' limits, with their positions; all groups of a plan without one. NULL sorts as the largest value in both directions.

    Which field sorts, and how, differs between plans, so there is a column for each place in the order and direction: it is NULL for all rows of
    a plan that it does not concern.
    """
    metric = F.map_from_entries(F.transform("__values", lambda v: F.struct(v["metric"], v["value"])))
    member = F.map_from_arrays("dimensions", "members")
    order: list[Column] = []
    fields = [*known["dimensions"], *known["metrics"]]
    number = [f for f, t in types.items() if isinstance(t, T.NumericType)]

    def keys(values: tuple[Column, ...], direction: Column | None) -> list[Column]:
        up = values if direction is None else [F.when(direction == "asc", v) for v in values]
        # Whether the value is missing comes first: last going up, first going down.
        missing = F.coalesce(*(v.cast("string") for v in values)).isNull()
        rising = [missing if direction is None else F.when(direction == "asc", missing), *up]
        falling = [] if direction is None else [F.when(direction == "desc", v) for v in (missing, *values)]
        return [*(c.asc() for c in rising), *(c.desc() for c in falling)]

    def value(field: Column) -> tuple[Column, ...]:
        text = member[field]
        return F.coalesce(metric[field], F.when(field.isin(*number), text.try_cast("double")) if number else F.lit(None).cast("double")), F.when(~field.isin(*number), text) if number else text

    for k in range(len(fields)):
        item = F.get("sort", F.lit(k))
        order += keys(value(item["field"]), item["direction"])
    for k in range(len(known["dimensions"])):
        order += keys(value(F.get("dimensions", F.lit(k))), None)
    # Groups of a plan without a limit have no order to wait for, so each is by itself.
    free = F.when(F.col("row_limit").isNull(), F.xxhash64("members"))
    ranked = groups.withColumns({"__free": free, "__rank": F.row_number().over(W.partitionBy("plan_key", free).orderBy(*order))})
    # The constant bound lets every task drop what no plan could show before the shuffle.
    first = ranked.filter((F.col("__rank") <= MAX_LIMIT) | F.col("__free").isNotNull()).filter(F.col("row_limit").isNull() | (F.col("__rank") <= F.col("row_limit")))
    position = F.when(F.col("__free").isNull(), F.col("__rank").cast("long") - 1)
    return first.select("plan_key", position.alias("position"), "members", "__values")
