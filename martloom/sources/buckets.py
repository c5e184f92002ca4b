"""Tables written in buckets of a key, so that an upsert rewrites only the buckets that its rows fall into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


class BucketTable:
    """A folder of Parquet files, one partition per bucket of ``keys``. The number of buckets stays as first written.

    Choose as many buckets as make one a comfortable task. ``schema`` is that of the rows, without the bucket.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = None

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, placed: DataFrame) -> None:
        # Rebalanced rather than hashed by bucket, so a bucket that outgrew the others is written by several tasks.
        out = placed.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET)
        out.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def create(self, rows: DataFrame) -> BucketTable:
        self.schema = rows.schema
        self._write(self._placed(rows))
        return self

    def _read(self) -> DataFrame:
        if self.schema is None:
            raise ValueError("the table was not created")
        stated = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in self.schema.fields)}, {BUCKET} int"
        return self.spark.read.schema(stated).parquet(self.path)

    def read(self) -> DataFrame:
        return self._read().drop(BUCKET)

    def upsert(self, edits: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets that ``edits`` fall into by ``merge(their rows, edits)`` and returns them; other files are neither read nor written.

        New files are written beside the old ones, which go when all are complete, so a failed upsert changes nothing and can be run again. ``merge``
        must return the table's columns and keep keys in their buckets. One number per bucket at most comes to the driver.
        """
        touched = sorted(r[0] for r in self._placed(edits.select(*self.keys)).select(BUCKET).distinct().collect())
        if touched:
            rows = self._read().filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
            self._write(self._placed(merge(rows, edits).select(*self.schema.names)))
        return touched
