"""Analysis plans: filter, group, aggregate, sort and limit over one mart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from martloom.operators import distinct_counts

MAX_LIMIT = 500  # a stated limit beyond this is a violation
AGGREGATIONS: dict[str, Callable[[str], Column]] = {
    "sum": F.try_sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
}


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: str | int | float | bool | None

    def condition(self, field_type: DataType) -> Column:
        """Three-valued comparison in the field's own type: NULL, on either side, keeps nothing, for != too.

        A value that is none of the field's type, such as a word beside a date, is NULL.
        """
        text = str(self.value).lower() if isinstance(self.value, bool) else self.value
        literal = (F.lit(None) if text is None else F.lit(str(text))).cast("string").try_cast(field_type)
        return F.col(self.field) == literal if self.operator == "=" else F.col(self.field) != literal


@dataclass(frozen=True)
class AnalysisPlan:
    source_model: str
    metrics: tuple[tuple[str, str], ...]
    dimensions: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    sort: tuple[tuple[str, str], ...] = field(default=())
    limit: int | None = None


def _order(name: str, direction: str) -> Column:
    # NULLs sort as the largest value in both directions.
    return F.col(name).asc_nulls_last() if direction == "asc" else F.col(name).desc_nulls_first()


def _kept(rows: DataFrame, filters: tuple[Filter, ...]) -> DataFrame:
    conditions = [f.condition(rows.schema[f.field].dataType) for f in filters]
    return rows.filter(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def run_plan(mart: DataFrame, plan: AnalysisPlan, members: dict[str, DataFrame] | None = None) -> DataFrame:
    """Aggregates re-aggregate the mart's own columns and take the metric's name.

    Summing a distinct count or averaging an average is therefore as additive as the mart makes it, unless ``members`` has the
    bitmaps of that count beside the mart (``distinct_counts.members``): its sum is then the true distinct count over the
    plan's dimensions. All groups are returned unless the plan states a limit; the group columns then settle ties,
    so the same rows come each time.
    """
    rows = _kept(mart, plan.filters)
    members = members or {}
    true = [name for name, how in plan.metrics if how == "sum" and name in members]
    aggregates = [AGGREGATIONS[how](name).alias(name) for name, how in plan.metrics if name not in true]
    dimensions = list(dict.fromkeys(plan.dimensions))
    # A group without other metrics is still a group, so rows are counted whatever else is asked.
    result = rows.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("__rows"), *aggregates)
    for name in true:
        counts = distinct_counts.counted(_kept(members[name], plan.filters), dimensions).withColumnRenamed("members", name)
        # Groups of both sides are brought together without a join, so that NULL groups meet too.
        both = result.unionByName(counts, allowMissingColumns=True)
        first = [F.first(c, ignorenulls=True).alias(c) for c in both.columns if c not in dimensions]
        result = both.groupBy(*dimensions).agg(*first)
    result = result.select(*dimensions, *(name for name, _ in plan.metrics))
    order = list(plan.sort)
    if plan.limit is not None:
        order += [(name, "asc") for name in dimensions if name not in dict(order)]
    if order:
        result = result.orderBy(*(_order(name, direction) for name, direction in order))
    return result if plan.limit is None else result.limit(plan.limit)
