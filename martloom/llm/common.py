"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.session import scratch_folder

# A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def row_key(df: DataFrame) -> list[Column]:
    """128 bits that tell rows apart by all their columns, nulls included: ``__h1`` and ``__h2``.

    Rows that agree in every column share a key; such rows cannot be told apart by anything else.
    """
    cells = [x for c in df.columns for x in (F.isnull(F.col(f"`{c}`")), F.col(f"`{c}`"))]
    return [F.xxhash64(F.lit(1), *cells).alias("__h1"), F.xxhash64(F.lit(2), *cells).alias("__h2")]


def packed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` next to ``__row``, the whole row as a struct, so that names an operator adds meet no name of the table's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *columns)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet copy in the shared checkpoint folder, so that lost executors cost no recomputation.

    The copy goes when the session's JVM ends, or earlier by :func:`forgotten`.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "llm")
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._scratch = path
    return copy


def forgotten(*copies: DataFrame) -> None:
    """Deletes copies made by :func:`written` that no later step reads."""
    for copy in copies:
        spark = copy.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(copy._scratch)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_slices(batches: Iterator[pa.RecordBatch], limit: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices that hold about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def given_back() -> None:
    """Returns the memory that this worker has freed to the system. A worker lives on for other stages, which would have it beside their own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def coded_words(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of UTF-8 text as places in a list of its distinct words, and that list."""
    raw = raw.strip()
    if not raw:
        return np.zeros(0, np.int64), []
    # The split looks for ASCII bytes only, so texts need not be checked again.
    words = pc.ascii_split_whitespace(pa.array([raw], pa.large_binary()).view(pa.large_string())).flatten().dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary.view(pa.large_binary()).to_pylist()
