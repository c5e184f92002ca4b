"""Helpers shared by the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]


def presentable(df: DataFrame) -> DataFrame:
    """Plain output types: decimals as doubles, dates as ISO text, text arrays joined by a bar."""

    def plain(f: T.StructField):
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(f.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            col = col.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), "|")
        return col.alias(f.name)

    return df.select(*(plain(f) for f in df.schema.fields))


class Registry:
    """Collects queries and the SQL each one must agree with."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = lambda spark, sf_dir: presentable(build(spark, sf_dir))
        if sql is not None:
            self.sql[name] = sql.strip()

    def query(self, name: str, sql: str | None = None):
        def register(build: Query) -> Query:
            self.add(name, build, sql)
            return build

        return register
