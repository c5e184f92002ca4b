"""Small fixed tables as literals, so the planner knows how small they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _literal(value):
    return F.array(*(F.lit(v) for v in value)) if isinstance(value, (list, tuple)) else F.lit(value)


def rows(spark: SparkSession, names: list[str], values: list[tuple]) -> DataFrame:
    structs = [F.struct(*(_literal(v).alias(n) for n, v in zip(names, row))) for row in values]
    return spark.range(1).select(F.inline(F.array(*structs)))


def catalog(spark: SparkSession, marts: dict[str, dict]) -> DataFrame:
    """Mart catalog as (mart, grain, dimensions, metrics)."""
    return rows(
        spark,
        ["mart", "grain", "dimensions", "metrics"],
        [(name, m["grain"], m["dimensions"], m["metrics"]) for name, m in marts.items()],
    )
