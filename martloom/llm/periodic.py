"""Periodic runs of words by Baier grouping.

The first phase of Baier's suffix sorter parts the places of a word sequence into groups by the longest Lyndon word that begins there.
Run under an order of the words and under its reverse, it gives two Lyndon arrays, and every run has a Lyndon root
in one of them at its full length. Each root is extended to both sides by longest common extensions, found on exact
names of all stretches of 1, 2, 4, … words; roots that reach twice their length give the runs.

A run of period q and at least max(12, 2q) words repeats a window of six words at distance q, and such windows cover all of it. So
places outside of windows that stand twice in their document are in no run, and only the rest goes through the steps above.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import coded_words, in_slices

LEAST = 12  # words of a run
GRAM = LEAST // 2  # words of a window that a run must repeat
TEXT_BYTES = 1 << 22  # text worked on at once
_MIX = np.random.default_rng(13).integers(0, 1 << 64, GRAM + 1, np.uint64) | np.uint64(1)


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place.

    Groups start as the places of one code and are taken from the highest down. A place of the group at hand belongs to the nearest
    place before it that lies in a lower group; such places move into groups right above their own, the higher the
    more places they were named by, and their words grow by as many words of the group at hand.
    """
    n = len(codes)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        first.setdefault(c, []).append(i)
    members = [first[c] for c in sorted(first)]
    group = [0] * n
    for g, places in enumerate(members):
        for i in places:
            group[i] = g
    size = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    open_at = list(range(n + 1))  # place i as i + 1; leads to the nearest place at or before it that is in a lower group, 0 for none
    lengths = [1] * n
    g = len(members) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        long = size[g]
        for i in mine:
            lengths[i] = long
            open_at[i + 1] = i
        named: dict[int, int] = {}
        for i in mine:
            x = i
            while open_at[x] != x:
                open_at[x] = x = open_at[open_at[x]]
            if x:
                named[x - 1] = named.get(x - 1, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, times in named.items():
            moves.setdefault((group[p], times), []).append(p)
        last: dict[int, int] = {}
        for (h, times), places in sorted(moves.items()) if len(moves) > 1 else moves.items():
            under, new = last.get(h, h), len(members)
            over = above[under]
            members.append(places)
            size.append(size[h] + times * long)
            below.append(under)
            above.append(over)
            above[under] = below[over] = new
            last[h] = new
            for p in places:
                group[p] = new
        g = below[g]
    return lengths


def _names(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Per level k, equal numbers for equal stretches of 2**k codes. Ends where no stretch stands twice."""
    levels = [codes]
    while 1 << len(levels) <= longest:
        half, now = 1 << (len(levels) - 1), levels[-1].astype(np.int64)
        whole = len(codes) - 2 * half + 1
        if whole <= 0:
            break
        values, number = np.unique(now[:whole] * (len(codes) * 2 + 2) + now[half : half + whole], return_inverse=True)
        if len(values) == whole:
            break
        levels.append(np.concatenate([number, np.arange(whole, len(codes))]).astype(np.int32))
    return levels


def _ahead(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes agree from places ``a`` and ``b`` on; the last code agrees with no other."""
    got, end = np.zeros(len(a), np.int64), len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + got, end)] == levels[k][np.minimum(b + got, end)]
        got += same.astype(np.int64) << k
    return got


def _behind(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes agree before places ``a`` < ``b``; the first code agrees with no other."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - got - (1 << k), b - got - (1 << k)
        same = (x >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])
        got += same.astype(np.int64) << k
    return got


def runs(stretches: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Per stretch of codes its runs as rows of start, length and period, by start, then period."""
    if not stretches:
        return []
    top = max(int(s.max(initial=0)) for s in stretches) + 1
    parts, starts, at = [], [], 0
    for k, s in enumerate(stretches):
        parts += [np.array([top + k]), s]
        starts.append(at + 1)
        at += len(s) + 1
    _, codes = np.unique(np.concatenate([*parts, [top + len(stretches)]]), return_inverse=True)
    levels = _names(codes.astype(np.int32), max(map(len, stretches)))
    place, period = [], []
    for s, start in zip(stretches, starts):
        plain = codes[start : start + len(s)].tolist()
        for order in (plain, [-c for c in plain]):
            place.append(np.arange(start, start + len(s)))
            period.append(np.array(lyndon_lengths(order), np.int64))
    a, p = np.concatenate(place), np.concatenate(period)
    right, left = _ahead(levels, a, a + p), _behind(levels, a, a + p)
    long = left + p + right
    some = (long >= 2 * p) & (long >= least)
    found = np.unique(np.stack([(a - left)[some], p[some], long[some]], axis=1), axis=0)[:, [0, 2, 1]]
    cuts = np.searchsorted(found[:, 0], [*starts, at + 1])
    return [found[x:y] - [start, 0, 0] for x, y, start in zip(cuts, cuts[1:], starts)]


def _stretches(codes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """Document, start and end of all maximal stretches covered by windows that their document holds twice."""
    n = len(codes) - GRAM + 1
    if n <= 0:
        return []
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    key = doc[:n].astype(np.uint64) * _MIX[GRAM]
    for j in range(GRAM):
        key += (codes[j : j + n].astype(np.uint64) + np.uint64(1)) * _MIX[j]
        key ^= key >> np.uint64(29)
    whole = np.flatnonzero(doc[:n] == doc[GRAM - 1 :])
    order = whole[np.argsort(key[whole], kind="stable")]
    along = key[order]
    same = along[1:] == along[:-1]
    again = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + GRAM, -1)
    covered = np.r_[False, step[:-1].cumsum() > 0, False]
    # A document's last word and the next one's first are never one stretch.
    first = np.r_[True, doc[1:] != doc[:-1]]
    begins = np.flatnonzero(covered[1:-1] & (~covered[:-2] | first))
    closes = np.flatnonzero(covered[1:-1] & (~covered[2:] | np.r_[first[1:], True])) + 1
    return [(int(doc[a]), int(a), int(b)) for a, b in zip(begins, closes) if b - a >= LEAST]


def planted(doc_id: int | None, codes: np.ndarray) -> np.ndarray:
    """The words of one document in ten made periodic from some word on, by the id's checksum; other documents, and null ids, stay."""
    n = len(codes)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return codes
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([codes[:a], codes[a : a + p][np.arange(n - a) % p]])


Change = Callable[[int | None, np.ndarray], np.ndarray]


def documents_runs(ids: list[int | None], texts: list[bytes], change: Change | None = None) -> Iterator[tuple]:
    """Per document: id, runs, and the words that stay once each run is cut to its first period."""
    split = [t.split() for t in texts]
    flat, listed = coded_words(b"\n".join(texts))
    ends = np.cumsum(list(map(len, split)))
    if change:
        for k, codes in enumerate(np.split(flat, ends[:-1])):
            now = change(ids[k], codes)
            if now is not codes:
                codes[:], split[k] = now, [listed[c] for c in now.tolist()]
    places = _stretches(flat, ends)
    found: dict[int, list[np.ndarray]] = {}
    for (doc, a, _), rows in zip(places, runs([flat[a:b] for _, a, b in places])):
        if len(rows):
            found.setdefault(doc, []).append(rows + [a - (ends[doc] - len(split[doc])), 0, 0])
    for k, words in enumerate(split):
        mine = np.concatenate(found[k]) if k in found else np.zeros((0, 3), np.int64)
        if len(mine):
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, mine[:, 0] + mine[:, 2], 1)
            np.add.at(step, mine[:, 0] + mine[:, 1], -1)
            words = [w for w, gone in zip(words, (step.cumsum() > 0).tolist()) if not gone]
        yield ids[k], mine, words


OUT = pa.schema([
    ("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
])
OUT_SQL = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
DIGEST_SQL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
DIGEST = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in DIGEST_SQL.split(", ")])


def _digest(doc: int | None, found: np.ndarray, words: list[bytes]) -> tuple:
    best: tuple = (None,) * 4
    if len(found):
        start, length, period = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]))
        best = (start, length, period, 1000 * length // period)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
    return (doc, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def _row(doc: int | None, found: np.ndarray, words: list[bytes]) -> tuple:
    return doc, [dict(zip(("start", "length", "period"), r)) for r in found.tolist()], b" ".join(words).decode("utf-8", "replace")


def _finder(digest: bool, change: Change | None):
    schema, shape = (DIGEST, _digest) if digest else (OUT, _row)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in in_slices(batches, TEXT_BYTES):
            texts = [t or b"" for t in few.column(1).cast(pa.binary()).to_pylist()]
            rows = [shape(*r) for r in documents_runs(few.column(0).to_pylist(), texts, change)]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    return find


def found(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """Per row ``doc_id``, ``runs`` (start, length and period, by start, then period) and ``collapsed``, the words left when each run is cut
    to its first period, joined by one space.

    Null texts are empty; texts without a run have an empty list. Rows are judged one by one, so repeated rows give equal
    rows, and no row meets another: nothing is shuffled. Work is proportional to a text's words times the logarithm of its longest
    repeat, and so is memory, for its covered words. ``change`` may rewrite a document's word numbers first.
    """
    return _applied(docs, False, change)


def report(docs: DataFrame, change: Change | None = planted) -> DataFrame:
    """Per row the number of runs, the longest one (ties: smallest start, then period; nulls without a run), and digests of the runs
    and of the collapsed words, of texts with planted periods."""
    return _applied(docs, True, change)


def _applied(docs: DataFrame, digest: bool, change: Change | None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_finder(digest, change), DIGEST_SQL if digest else OUT_SQL)
