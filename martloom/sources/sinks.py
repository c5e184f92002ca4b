"""Table and snapshot sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.plans.analysis import AnalysisPlan


def parquet_writer(folder: str, partitioned: dict[str, str] | None = None) -> Callable[[str, DataFrame], DataFrame]:
    """Writer for layered models: each model becomes a folder, rebuilt whole, and is read back.

    A partitioned model is rebalanced by its partition column first. That shuffle splits a column
    value holding much of the table over several tasks and packs small values together.
    """
    by = partitioned or {}

    def write(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        if name in by:
            df.hint("rebalance", F.col(by[name])).write.mode("overwrite").option("compression", "zstd").partitionBy(by[name]).parquet(path)
        else:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        # The stated schema keeps types that partition folders would otherwise have guessed.
        return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)

    return write


def table_writer(partitioned: dict[str, str] | None = None) -> Callable[[str, DataFrame], DataFrame]:
    """Writer for layered models that saves each one in the session catalog."""
    by = partitioned or {}

    def write(name: str, df: DataFrame) -> DataFrame:
        if name in by:
            df.hint("rebalance", F.col(by[name])).write.mode("overwrite").partitionBy(by[name]).saveAsTable(name)
        else:
            df.write.mode("overwrite").saveAsTable(name)
        return df.sparkSession.table(name).select(*df.columns)

    return write


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and timestamps as ISO text."""

    def safe(f: T.StructField):
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return col.cast("double").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(col, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name)
        return col

    return df.select(*(safe(f) for f in df.schema.fields))


def as_chart_result(snapshot: DataFrame, plan: AnalysisPlan, question: str, intent: str | None = None, grain: str = "") -> DataFrame:
    """A result snapshot in the shape charts are chosen from: what was asked, and preview rows as field to text."""
    names = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    return snapshot.select(
        F.lit(0).alias("run_id"), F.lit(question).alias("question"), F.lit(intent).cast("string").alias("intent"),
        F.lit(plan.source_model).alias("source_model"), F.lit(grain).alias("grain"),
        names(name for name, _ in plan.metrics).alias("metrics"), names(plan.dimensions).alias("dimensions"), "output_schema",
        F.transform("preview_rows", lambda row: F.from_json(F.to_json(row), "map<string,string>")).alias("preview_rows"),
    )


def result_snapshot(result: DataFrame, preview_limit: int = 100) -> DataFrame:
    """One row: output schema, the first rows and how many of them there are.

    The count is that of the preview, not of the whole result.
    """
    fields = F.array(
        *(
            F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"))
            for f in result.schema.fields
        )
    )
    # The limit leaves one partition holding at most preview_limit rows, in result order.
    first = json_safe(result.limit(preview_limit)).withColumn("__at", F.monotonically_increasing_id())
    rows = first.agg(
        F.array_sort(F.collect_list(F.struct("__at", F.struct(*result.columns).alias("row")))).alias("rows")
    )
    return rows.select(
        fields.alias("output_schema"),
        F.transform("rows", lambda item: item["row"]).alias("preview_rows"),
        F.size("rows").cast("long").alias("row_count"),
    )
