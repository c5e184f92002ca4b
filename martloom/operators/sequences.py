"""Newest-row and previous-row operators that stay balanced when one key holds much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key, as an aggregate: each task reduces its rows to
    one per key before the shuffle, where a ranking window would sort the whole group in one task."""
    best = F.max_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def oldest(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    best = F.min_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key. The rank filter lets every task drop rows before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= k).drop("__rank")


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], value: str, alias: str, cut: Column
) -> DataFrame:
    """Add the value of the preceding row of the same key, in ``order`` (which must be unique).

    ``cut`` cuts each key's rows into slices and must never fall while ``order`` rises, such as the day of a
    leading timestamp. The window runs inside a slice, so a key that holds much of the table spreads over as many tasks as it has
    slices; only the last value per key and slice travels on to the next slice.
    """
    sliced = df.withColumn("__slice", cut)
    inside = W.partitionBy(*keys, "__slice").orderBy(*order)
    rows = sliced.withColumns(
        {"__previous": F.lag(value).over(inside), "__first": F.row_number().over(inside) == 1}
    )
    tails = sliced.groupBy(*keys, "__slice").agg(F.max_by(value, F.struct(*order)).alias("__tail"))
    between = W.partitionBy(*keys).orderBy("__slice")
    carried = tails.select(
        *(F.col(k).alias(f"__{k}") for k in keys), F.col("__slice").alias("__at"), F.lag("__tail").over(between).alias("__carry")
    )
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = rows.join(carried, [*same, F.col("__slice").eqNullSafe(F.col("__at"))], "left")
    previous = F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__previous"))
    return met.select(*df.columns, previous.alias(alias))
