"""Distinct counts that can be aggregated again.

A mart that stores how many orders each of its groups has cannot say how many a coarser group has, since an order may be in
several. Beside such a mart goes a table of members: keys get numbers from a dictionary, and each group holds
them as bitmaps of 64 numbers, one long each. Bitmaps of any groups are joined by ``or``, so every coarser count is exact and needs
no key again. A group with few members, far apart, has a long for each of them and never more, so members take no more room than the
rows they come from, however many groups there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.session import scratch_folder


def dictionary(rows: DataFrame, key: str, near: str | None = None, folder: str | None = None) -> DataFrame:
    """(``key``, ``number``) with one number for each key that is not NULL.

    Keys are numbered along ``near``, the smallest value that goes with a key, or else along themselves. Groups that follow ``near``, such as months, then have
    their members in few bitmaps. A task numbers its keys without gaps and leaves the rest of its numbers free, so numbers need no
    pass over all tasks. They are written down, in ``folder`` or in the shared folder, since another run could deal keys otherwise.
    """
    spark = rows.sparkSession
    along = F.min(near) if near else F.min(key)
    keys = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(along.alias("__along"))
    ordered = keys.repartitionByRange("__along", key).sortWithinPartitions("__along", key)
    path = folder or scratch_folder(spark, "dictionary")
    numbered = ordered.select(key, F.monotonically_increasing_id().alias("number"))
    numbered.write.parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def members(rows: DataFrame, dimensions: list[str], key: str, numbers: DataFrame) -> DataFrame:
    """(dimensions, ``bucket``, ``bits``): the members of each group, NULL groups included. Keys that are NULL are no members."""
    found = rows.select(*dimensions, key).join(numbers, key)
    # 64 is two to the sixth: the number's upper bits name the bitmap, its lower six the place in it.
    bit = F.expr("shiftleft(1L, cast(number & 63 as int))")
    return found.groupBy(*dimensions, F.shiftright("number", 6).alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def coarser(found: DataFrame, dimensions: list[str]) -> DataFrame:
    """Members of the groups of fewer dimensions."""
    return found.groupBy(*dimensions, "bucket").agg(F.bit_or("bits").alias("bits"))


def counted(found: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimensions, ``members``): how many distinct keys each group has. Without dimensions there is one row, 0 without members."""
    ones = coarser(found, dimensions).select(*dimensions, F.bit_count("bits").alias("__ones"))
    return ones.groupBy(*dimensions).agg(F.coalesce(F.sum("__ones"), F.lit(0)).alias("members"))
