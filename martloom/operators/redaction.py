"""Redaction of texts by a table of secrets, all in one pass.

Every secret has an anchor: its first four characters, or all of a shorter one. The places of a text whose
characters could be an anchor, by a bitmap of anchor hashes, are found in Arrow batches, joined with the secrets and compared in full. Found spans that
overlap become one. Texts fall into chunks, and only those that a span touches are written anew. So the shuffle carries places that begin like a secret
rather than texts, however many secrets there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.functions.text import REDACTED

ANCHOR = 4  # characters
CHUNK = 256  # characters
SLOT_BITS = 20  # of the bitmap's 2**20 slots
TEXT_BYTES = 1 << 22  # text looked through together
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _hashed(points: np.ndarray, size: int) -> np.ndarray:
    """A slot for each run of ``size`` code points."""
    many = len(points) - size + 1
    if many < 1:
        return np.empty(0, np.int64)
    mixed = np.full(many, size, np.uint64)
    for k in range(size):
        mixed = (mixed + points[k : k + many]) * _TIMES
        mixed ^= mixed >> np.uint64(32)
    return (mixed * _TIMES >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _slots(anchors: pa.Array) -> pa.Array:
    return pa.array([int(_hashed(p := _points(a.as_py()), len(p))[0]) for a in anchors], pa.int64())


def _places(bitmap: np.ndarray, sizes: dict[int, int]):
    """The places of texts that could begin a secret, by the bitmap: ``__key``, ``__start``, ``__size``, and as much of the text as the longest
    secret with an anchor of that size may need."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in in_slices(batches, TEXT_BYTES):
            rows, starts, widths, ahead = [], [], [], []
            held = 0
            for row, text in enumerate(few.column(1)):
                if not text.is_valid:
                    continue
                text = text.as_py()
                points = _points(text)
                for size, longest in sizes.items():
                    slots = _hashed(points, size)
                    for at in np.flatnonzero(bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).tolist():
                        piece = text[at : at + longest]
                        rows.append(row), starts.append(at), widths.append(size), ahead.append(piece)
                        held += len(piece)
                        # Long secrets make long pieces, so rows leave by their size.
                        if held > TEXT_BYTES:
                            yield _found(few, rows, starts, widths, ahead)
                            rows, starts, widths, ahead, held = [], [], [], [], 0
            yield _found(few, rows, starts, widths, ahead)

    return find


def _found(texts: pa.RecordBatch, rows: list[int], starts: list[int], widths: list[int], ahead: list[str]) -> pa.RecordBatch:
    key = texts.column(0).take(pa.array(rows, pa.int64()))
    return pa.record_batch([key, pa.array(starts, pa.int32()), pa.array(widths, pa.int32()), pa.array(ahead, pa.string())], ["__key", "__start", "__size", "__ahead"])


def in_slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) in slices of at most ``limit`` bytes by the batch's average, one row at least."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(limit, batch.column(1).nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _anchored(secrets: DataFrame) -> DataFrame:
    known = secrets.select(F.col("secret").cast("string").alias("secret")).filter("secret <> ''").distinct()
    size = F.least(F.length("secret"), F.lit(ANCHOR))
    return known.select("secret", size.alias("__size"), F.substring("secret", 1, ANCHOR).alias("__anchor"))


def spans(texts: DataFrame, key: str, text: str, secrets: DataFrame) -> DataFrame:
    """(``key``, ``start``, ``end``) of the merged spans, from 0, end exclusive. Spans that share a character are one; spans that only touch are
    two. ``secrets`` has a column ``secret``; NULL and empty secrets are none."""
    anchors = _anchored(secrets)
    sizes = {r["__size"]: r["longest"] for r in anchors.groupBy("__size").agg(F.max(F.length("secret")).alias("longest")).collect()}
    none = texts.select(key, F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    if not sizes:
        return none
    # At most one number per 64 slots comes to the driver, whatever the number of secrets.
    slots = anchors.select("__anchor").distinct().select(F.arrow_udf(_slots, "long")("__anchor").alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (SLOT_BITS - 6), "<i8")
    for r in words.collect():
        bitmap[r["word"]] = r["bits"]
    kind = T.StructType([
        T.StructField("__key", texts.schema[key].dataType), T.StructField("__start", T.IntegerType()), T.StructField("__size", T.IntegerType()),
        T.StructField("__ahead", T.StringType()),
    ])
    places = texts.select(F.col(key).alias("__key"), F.col(text).cast("string")).mapInArrow(_places(bitmap.view(np.uint8), sizes), kind)
    named = places.withColumn("__anchor", F.substring("__ahead", F.lit(1), F.col("__size")))
    hits = named.join(anchors, ["__size", "__anchor"]).filter(F.startswith("__ahead", "secret"))
    found = hits.groupBy("__key", F.col("__start").alias("start")).agg(F.max(F.length("secret")).alias("__long")).withColumn("end", F.col("start") + F.col("__long"))
    # Islands of overlapping spans: one begins where no earlier span reaches.
    earlier = W.partitionBy("__key").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    begins = found.withColumn("__new", F.coalesce(F.max("end").over(earlier) <= F.col("start"), F.lit(True)).cast("int"))
    islands = begins.withColumn("__island", F.sum("__new").over(W.partitionBy("__key").orderBy("start")))
    merged = islands.groupBy("__key", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(F.col("__key").alias(key), "start", "end")


def redact(texts: DataFrame, key: str, text: str, secrets: DataFrame) -> DataFrame:
    """``texts`` with every merged span of :func:`spans` replaced by one mark. ``key`` tells rows apart; NULL texts stay NULL."""
    found = spans(texts, key, text, secrets).withColumnRenamed(key, "__key")
    touched = F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("end") - 1) / CHUNK))
    parts = found.select("__key", "start", "end", F.explode(touched).alias("__chunk"))
    low = F.col("__chunk") * CHUNK
    inside = parts.groupBy("__key", "__chunk").agg(
        F.sort_array(F.collect_list(F.struct(
            F.greatest(F.col("start") - low, F.lit(0)).alias("a"), F.least(F.col("end") - low, F.lit(CHUNK)).alias("b"), (F.col("start") >= low).alias("first"),
        ))).alias("cuts")
    )
    per_text = inside.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("__chunk").cast("int").alias("k"), "cuts"))).alias("__cuts"))

    def rewritten(chunk: Column, cuts: Column) -> Column:
        """A chunk without its spans; the mark stands where a span begins, so one that began in an earlier chunk leaves none here."""
        start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
        done = F.aggregate(
            cuts, start,
            lambda s, c: F.struct(
                F.concat(s["text"], F.substring(chunk, (s["at"] + 1).cast("int"), (c["a"] - s["at"]).cast("int")), F.when(c["first"], REDACTED).otherwise("")).alias("text"),
                c["b"].cast("long").alias("at"),
            ),
        )
        return F.concat(done["text"], F.substring(chunk, (done["at"] + 1).cast("int"), F.lit(CHUNK)))

    whole = texts.join(per_text, texts[key] == per_text["__key"], "left")
    pieces = F.transform(_chunks(F.col(text)), lambda c, i: F.when(F.map_contains_key("__cuts", i), rewritten(c, F.col("__cuts")[i])).otherwise(c))
    clean = F.when(F.col("__cuts").isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))
    return whole.select(*(clean.alias(c) if c == text else texts[c] for c in texts.columns))
