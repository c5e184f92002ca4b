"""Replay of uploads against a session's limit, in order: a refused upload uses nothing, so what is admitted depends on all that was
admitted before.

A session's log is cut into slices of time. What a slice does to the room that is left when it begins is a step function: over a few ranges of
room it takes a fixed amount. Slices are turned into such functions side by side, a session's functions are applied
one after the other to its limit, which gives the room each slice begins with, and then all slices are replayed side by side.
So a session that holds much of the log is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def steps(sizes: list[int], limit: int, ranges: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """What uploads of ``sizes``, in order, take from each amount of room from 0 to ``limit``: (room from which on, amount taken), rising. ``ranges``
    are those of earlier uploads.

    An upload splits a range where some of its room is enough and some is not. Ranges that come out alike are put together, and there are never
    more of them than amounts of room.
    """
    ranges = ranges or [(0, 0)]
    for size in sizes:
        if not 0 < size <= limit:
            continue
        out: list[tuple[int, int]] = []
        for k, (low, taken) in enumerate(ranges):
            high = ranges[k + 1][0] if k + 1 < len(ranges) else limit + 1
            need = size + taken  # room from which on this range admits the upload
            for start, amount in ((low, taken), (need, taken + size)) if low < need < high else ((low, taken if need >= high else taken + size),):
                if not out or out[-1][1] != amount:
                    out.append((start, amount))
        ranges = out
    return ranges


def room_after(ranges: list[tuple[int, int]], room: int) -> int:
    return room - ranges[bisect_right(ranges, (room, float("inf"))) - 1][1]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Runs of rows with one ``__key``, the first column; a key may come in several runs, one after the other."""
    for batch in batches:
        keys = batch.column(0)
        ends = pc.run_end_encode(keys).run_ends.to_pylist() if len(keys) else []
        for start, end in zip([0, *ends], ends):
            yield keys[start].as_py(), batch.slice(start, end - start)


def _fold(limit: int):
    """Step functions of slices, from rows sorted by slice and order."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ranges, done = None, [(0, 0)], []
        for k, rows in _by_key(batches):
            if k != key:
                if key is not None:
                    done.append((key, ranges))
                key, ranges = k, [(0, 0)]
            ranges = steps(rows.column(1).to_pylist(), limit, ranges)
            if len(done) >= 4096:
                yield shown(done)
                done = []
        if key is not None:
            done.append((key, ranges))
        if done:
            yield shown(done)

    def shown(done: list) -> pa.RecordBatch:
        lows, amounts = ([[r[i] for r in ranges] for _, ranges in done] for i in (0, 1))
        return pa.record_batch([pa.array([k for k, _ in done], pa.string()), pa.array(lows, NUMBERS), pa.array(amounts, NUMBERS)], names=["__key", "lows", "amounts"])

    return fold


NUMBERS = pa.list_(pa.int64())


def _chain(limit: int):
    """The room each slice begins with, from functions sorted by session and slice."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, room = None, limit
        for batch in batches:
            out = []
            for s, key, lows, amounts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if s != session:
                    session, room = s, limit
                out.append((key, room))
                room = room_after(list(zip(lows, amounts)), room)
            yield pa.record_batch([pa.array([k for k, _ in out], pa.string()), pa.array([r for _, r in out], pa.int64())], names=["__key", "__room"])

    return chain


def _judge(limit: int):
    """Rows with what was used before them, from rows sorted by slice and order that know their slice's room."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, room = None, limit
        for batch in batches:
            used, admitted = [], []
            for k, size, begin in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if k != key:
                    key, room = k, begin
                used.append(limit - room)
                admitted.append(size <= room)
                room -= size if 0 < size <= room else 0
            names = [*batch.schema.names[3:], "used_before", "admitted"]
            yield pa.record_batch([*batch.columns[3:], pa.array(used, pa.int64()), pa.array(admitted, pa.bool_())], names=names)

    return judge


def replay(log: DataFrame, size: Column, order: list[str], slice_of: Column, limit: int, session: str = "session_id") -> DataFrame:
    """``session``, ``order``, ``used_before`` and ``admitted`` of every row of ``log``, each upload judged by what the session had used at that moment.

    ``size`` is a whole number of units, ``limit`` the units a session may use; an upload is admitted if it fits in what is left. ``order`` tells a
    session's rows apart and puts them in their order, which ``slice_of`` must follow. Sizes that are NULL or not above 0 are no uploads: they
    use nothing and are admitted. Rows without a session are one session's. A task holds a batch of rows and one step function.
    """
    own = log.select(*(F.col(c) for c in dict.fromkeys([session, *order])), F.coalesce(size.cast("long"), F.lit(0)).alias("__size"), slice_of.alias("__slice"))
    whose = F.to_json(F.struct(F.col(session).alias("s")))
    rows = own.withColumns({"__session": whose, "__key": F.to_json(F.struct(F.col(session).alias("s"), F.col("__slice").alias("t")))})
    in_order = lambda df: df.repartition("__key").sortWithinPartitions("__key", *order)
    functions = in_order(rows).select("__key", "__size").mapInArrow(_fold(limit), "__key string, lows array<long>, amounts array<long>")
    slices = rows.select("__key", "__session", "__slice").distinct().join(functions, "__key")
    linked = slices.repartition("__session").sortWithinPartitions("__session", "__slice").select("__session", "__key", "lows", "amounts")
    rooms = linked.mapInArrow(_chain(limit), "__key string, __room long")
    names = list(dict.fromkeys([session, *order]))
    placed = in_order(rows.join(rooms, "__key")).select("__key", "__size", "__room", *names)
    shape = T.StructType([*(own.schema[c] for c in names), T.StructField("used_before", T.LongType()), T.StructField("admitted", T.BooleanType())])
    return placed.mapInArrow(_judge(limit), shape)
