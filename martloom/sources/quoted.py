"""CSV files whose quoted cells hold line breaks, read from all their splits at once.

A line feed ends a record if an even number of quotes stands before it in its file. So a split only needs to know whether the quotes of the
splits before it are even: one small count per split and prefix sums over those. Lines then become records where they are
scanned, in batches and without a shuffle. A record that runs over the end of its split leaves a piece at the end of that split and pieces
at the beginning of the next ones; only these pieces move, and are put together in the order of their splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.session import scratch_folder
from martloom.sources import raw_csv

# Splits that begin inside a quoted cell are few or many as the data have it. Up to this many are broadcast; beyond, lines are joined
# with them by a shuffle and sorted again, with the same rows.
MOST_BROADCAST = 1_000_000

PIECES = "file long, start long, part int, opens boolean, closes boolean, first boolean, record string"
_PIECES = pa.schema([
    ("file", pa.int64()), ("start", pa.int64()), ("part", pa.int32()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("first", pa.bool_()), ("record", pa.string()),
])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are split, with the hash of their file, the byte at which their split begins, and an id that grows along a split."""
    scan = spark.read.option("lineSep", "\n").text(path)
    return scan.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"),
    )


def _inside(lines: DataFrame) -> DataFrame:
    """The splits (``file``, ``start``) that begin inside a quoted cell."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "start").agg(F.sum(quotes.cast("long")).alias("__quotes"))
    before = F.sum("__quotes").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    return splits.withColumn("__before", before).filter(F.pmod("__before", F.lit(2)) == 1).select("file", "start", F.lit(True).alias("inside"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines in scan order. ``part`` is 0 for what ends a record of an earlier split, 1 for all that begins in its own."""
    split: tuple[int, int] | None = None
    odd, head, fresh = False, False, False
    held: list[str] = []  # lines of the record that is open

    def rows(texts: pa.Array, part: int, opens: bool, closes: bool, first: bool) -> pa.RecordBatch:
        n = len(texts)
        firsts = np.zeros(n, bool)
        firsts[:1] = first
        file, start = split
        columns = (np.full(n, file), np.full(n, start), np.full(n, part, np.int32), np.full(n, opens), np.full(n, closes), firsts, texts)
        return pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_PIECES)

    def closed(done: bool) -> pa.RecordBatch:
        nonlocal head, fresh, held
        out = rows(pa.array(["\n".join(held)]), 0 if head else 1, not head, done, fresh and not head)
        fresh = fresh and head
        head, held = False, []
        return out

    for batch in batches:
        file, start, inside, lines = (batch.column(k) for k in range(4))
        keys = np.stack([file.to_numpy(), start.to_numpy()])
        cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = (int(keys[0, a]), int(keys[1, a]))
            if now != split:
                if held:
                    yield closed(False)
                split, odd = now, bool(inside[int(a)].as_py())
                head, fresh = odd, now[1] == 0
            part = lines.slice(a, b - a)
            flips = pc.count_substring(part, '"').to_numpy(zero_copy_only=False) & 1
            after = (np.cumsum(flips) + odd) & 1 == 1  # whether a cell is open behind each line
            odd = bool(after[-1])
            ends = np.flatnonzero(~after) + 1
            if not len(ends):
                held += part.to_pylist()
                continue
            at = 0
            if held or head:
                at = int(ends[0])
                held += part.slice(0, at).to_pylist()
                yield closed(True)
            inner = ends[ends > at]
            if len(inner):
                whole = pa.ListArray.from_arrays(pa.array(np.r_[at, inner], pa.int32()), part)
                yield rows(pc.binary_join(whole, "\n"), 1, True, True, fresh)
                fresh, at = False, int(inner[-1])
            held = part.slice(at).to_pylist()
    if held:
        yield closed(False)


def records(spark: SparkSession, path: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``record`` and ``first``, whether it is its file's first one, for every record of the files.

    Quotes count wherever they stand, as CSV asks for doubled quotes inside quoted cells and for none outside of them. Records end with a line
    feed, a carriage return before it is dropped; line breaks in cells stay as they are. A cell that is never closed
    runs to the end of its file. Records without a character are left out. A record is held whole by one task, however many splits it spans.
    """
    lines = _lines(spark, path)
    kept = scratch_folder(spark, "quoted")
    _inside(lines).write.parquet(kept)
    inside = spark.read.schema("file long, start long, inside boolean").parquet(kept)
    flag = F.coalesce("inside", F.lit(False)).alias("inside")
    if inside.count() <= most_broadcast:
        marked = lines.join(F.broadcast(inside), ["file", "start"], "left")
    else:
        marked = lines.join(inside, ["file", "start"], "left").repartition("file", "start").sortWithinPartitions("file", "start", "id")
    found = marked.select("file", "start", flag, "line").mapInArrow(_pieces, PIECES)
    # Scanned once: whole records go on, pieces are read again from the copy.
    copy = scratch_folder(spark, "quoted")
    found.write.parquet(copy)
    found = spark.read.schema(PIECES).parquet(copy)
    whole = F.col("opens") & F.col("closes")
    pieces = found.filter(~whole)
    # The places of pieces are numbered without their texts, since one task does that for a file.
    order = W.partitionBy("file").orderBy("start", "part")
    numbers = pieces.select("file", "start", "part", F.sum(F.col("opens").cast("long")).over(order).alias("__record"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part", "record"))), lambda p: p["record"]), "\n")
    stitched = pieces.join(numbers, ["file", "start", "part"]).groupBy("file", "__record").agg(joined.alias("record"), F.max("first").alias("first"))
    both = found.filter(whole).select("record", "first").unionByName(stitched.select("record", "first"))
    return both.select(F.regexp_replace("record", r"\r\z", "").alias("record"), "first").filter(F.col("record") != "")


def _cells(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    found = records(spark, path)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw_csv.CORRUPT}
    # Headers of the files, each under the order of its names; two are enough to say that they differ.
    headers = [r["record"] for r in found.filter("first").select("record").distinct().limit(2).collect()]
    if not headers:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*columns, raw_csv.CORRUPT]]))
    width = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(columns))] + [T.StructField(raw_csv.CORRUPT, T.StringType())])
    parse = F.from_csv("record", F.lit(width.simpleString()[7:-1].replace(":", " ")), options)
    names = found.filter("first").select(parse.alias("r")).select("r.*").first()
    given = [names[f"c{k}"] for k in range(len(columns))]
    if len(headers) > 1 or names[raw_csv.CORRUPT] is not None or sorted(map(str, given)) != sorted(columns):
        raise raw_csv.HeaderError(f"the headers are {headers}, not one of {columns}")
    return found.filter(~F.col("first")).select(parse.alias("r")).select(*(F.col(f"r.c{k}").alias(c) for k, c in enumerate(given)), f"r.{raw_csv.CORRUPT}")


def read_quoted_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """What ``read_raw_csv`` with ``multi_line`` returns, but from all splits of a file at once (see ``records``); line breaks in cells
    stay as they are, where Spark turns those of files with carriage returns into line feeds.

    Every file has its header, in one order of names for all files; other headers are an error. Rows of another width than the header are left out here.
    """
    good = _cells(spark, path, columns).filter(F.col(raw_csv.CORRUPT).isNull())
    return good.select(*(raw_csv.nulls_applied(F.col(c)).alias(c) for c in columns))


def diverted_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The records of another width, whole, as ``record``."""
    return _cells(spark, path, columns).filter(F.col(raw_csv.CORRUPT).isNotNull()).select(F.col(raw_csv.CORRUPT).alias("record"))
