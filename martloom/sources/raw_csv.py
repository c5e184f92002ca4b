"""Raw text loads: every column stays text, missing words become NULL, zero rows is an error."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.sources import positions as P

CORRUPT = "_corrupt_record"
# Field contents loaded as NULL. Nothing is trimmed first.
LOAD_NULLS = ("", "NULL", "null")
PREVIEW_MAX = 50


class EmptyLoadError(ValueError):
    """A load produced no rows."""


class HeaderError(ValueError):
    """A file's header does not hold the expected columns."""


def nulls_applied(col: Column) -> Column:
    return F.when(~col.isin(*LOAD_NULLS), col)


def _parsed(spark: SparkSession, path: str, columns: list[str], multi_line: bool) -> DataFrame:
    options = {
        "header": "true", "quote": '"', "escape": '"', "multiLine": str(multi_line).lower(), "enforceSchema": "false",
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false",
    }
    given = spark.read.options(**options).csv(path).columns
    if sorted(given) != sorted(columns):
        raise HeaderError(f"the header has {given}, not {columns}")
    # Every file is read in the order of the first one's header; Spark stops at a file with another order.
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*given, CORRUPT]])
    return spark.read.schema(schema).options(**options).csv(path)


def read_raw_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False, positions: bool = False) -> DataFrame:
    """Headered CSV as text, columns found by the header's names whatever their order.

    A header without just these names is an error. Rows of another width than the header are left out here and
    are what ``diverted_rows`` returns. Quoted line breaks need ``multi_line``, which reads each file in one task. With ``positions``
    rows also say where they stand among all data lines, diverted ones included (``positions.placed``).
    """
    parsed = _parsed(spark, path, columns, multi_line)
    extra = [P.FILE, P.FILE_ROW, P.LOAD_ROW] if positions else []
    if positions:
        parsed = P.placed(P.marked(parsed))
    good = parsed.filter(F.col(CORRUPT).isNull())
    return good.select(*(nulls_applied(F.col(c)).alias(c) for c in columns), *extra)


def diverted_rows(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """The lines a load leaves out, as they stand in the files: ``line``, ``n_cells``, split at plain commas, and ``first_cell``."""
    parsed = _parsed(spark, path, columns, multi_line)
    bad = parsed.filter(F.col(CORRUPT).isNotNull())
    bare = F.regexp_replace(CORRUPT, r'"(?:[^"]|"")*+"', "")
    return bad.select(F.col(CORRUPT).alias("line"), F.size(F.split(bare, ",")).cast("long").alias("n_cells"), F.col(parsed.columns[0]).alias("first_cell"))


def write_csv(df: DataFrame, path: str) -> None:
    """Text table to headered CSV with doubled quotes, keeping leading and trailing spaces."""
    (
        df.write.mode("overwrite")
        .option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )


def load_table(raw: DataFrame, name: str) -> DataFrame:
    """Save a raw load as a table. A load without rows fails, and a table of that name stays as it was.

    Rows go to a table of another name first, which takes the place of the old one once it is complete (``swap_in``).
    """
    spark = raw.sparkSession
    staged = f"{name}__load_{uuid.uuid4().hex[:8]}"
    raw.write.saveAsTable(staged)
    if spark.table(staged).isEmpty():
        spark.sql(f"DROP TABLE {staged}")
        raise EmptyLoadError(f"load into {name} produced no rows")
    swap_in(spark, staged, name)
    return spark.table(name)


def swap_in(spark: SparkSession, staged: str, name: str) -> None:
    """Puts a complete table in another one's place.

    The old table steps aside under a name of its own and is dropped only once the new one has the name. If the change fails in between,
    the old one gets its name back; should the session end just there, it still stands beside as ``<name>__old_…`` with all its rows.
    """
    if not spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
        return
    aside = f"{name}__old_{uuid.uuid4().hex[:8]}"
    spark.sql(f"ALTER TABLE {name} RENAME TO {aside}")
    try:
        spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    except Exception:
        spark.sql(f"ALTER TABLE {aside} RENAME TO {name}")
        raise
    spark.sql(f"DROP TABLE {aside}")


def preview(raw: DataFrame, columns: list[tuple[str, str]], order: list[str] | None = None, limit: int = 10) -> DataFrame:
    """The first rows, with table columns shown under their raw headers: in an explicit order, or else in that of the files, for rows read
    with ``positions``."""
    order = order or [P.LOAD_ROW]
    if not 1 <= limit <= PREVIEW_MAX:
        raise ValueError(f"preview limit must be between 1 and {PREVIEW_MAX}")
    if not columns:
        return raw.sparkSession.createDataFrame([], T.StructType([]))
    first = raw.orderBy(*(F.col(c).asc_nulls_last() for c in order)).limit(limit)
    return first.select(*(F.col(name).alias(shown) for name, shown in columns))


def drop_blank_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep rows with at least one cell that is more than whitespace."""
    cells = [F.coalesce(F.col(c).rlike(r"[^\s\p{Z}]"), F.lit(False)) for c in columns or df.columns]
    keep = cells[0]
    for cell in cells[1:]:
        keep = keep | cell
    return df.filter(keep)
