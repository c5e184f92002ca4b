"""Places of rows in the files they come from.

A scan knows each row's file and the byte at which its split begins, and rows of a split stay in order. So a row's place is the
number of rows in earlier splits plus its place in its own: one small count per split, prefix sums over those, and a join
back. The place does not depend on how files were split or tasks were dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILE, FILE_ROW, LOAD_ROW = "__file", "__file_row", "__load_row"


def marked(scan: DataFrame) -> DataFrame:
    """A file scan with what ``placed`` needs. Mark rows before any are filtered, so that all of them count."""
    return scan.select(
        "*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """Marked rows with ``__file``, ``__file_row`` (from 0 in each file) and ``__load_row`` (from 0 over all files, by path).

    The sums over files and splits take one row a split, so they go through one task.
    """
    splits = rows.groupBy(FILE, "__start").agg(F.count(F.lit(1)).alias("__rows"), F.min("__id").alias("__first"))
    before = lambda w: F.coalesce(F.sum("__rows").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = splits.select(
        FILE, "__start", "__first",
        before(W.partitionBy(FILE).orderBy("__start")).alias("__before"), before(W.orderBy(FILE, "__start")).alias("__ahead"),
    )
    own = F.col("__id") - F.col("__first")
    found = rows.join(sums, [FILE, "__start"])
    return found.withColumns({FILE_ROW: F.col("__before") + own, LOAD_ROW: F.col("__ahead") + own}).drop("__start", "__id", "__first", "__before", "__ahead")
