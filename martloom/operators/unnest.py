"""One row per array element, without evaluating the array twice, and joins with such rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list[str], elements: Column | str, name: str, position: str = "__at") -> DataFrame:
    """Elements of ``elements`` as rows next to the ``keep`` columns; empty arrays give no row.

    The outer generator is on purpose. For the inner one the optimizer adds a filter on the array's
    size and pushes it down to the scan, which evaluates an expensive array expression once more per
    row. The filter on the position stays above the generator.
    """
    rows = df.select(*keep, F.posexplode_outer(elements).alias(position, name))
    rows = rows.filter(F.col(position).isNotNull())
    return rows.drop(position) if position == "__at" else rows


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and sorted, whatever the planner takes its size for.

    A generator's rows are counted as one per row of the table behind it, so the planner takes many rows per dataset for
    a table that is small enough to be sent to the driver and from there to all executors.
    """
    return df.hint("merge")
