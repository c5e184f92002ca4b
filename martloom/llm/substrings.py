"""Substring dedup: Rabin-Karp hashes of every window of 35 words, counted in Spark.

Documents are dealt into blocks. A block sends its distinct window hashes, sorted and packed, to buckets by their leading
bits: a window that a third of all documents share arrives once per block. Each hash goes with a check of 32 bits from a second
sum, so windows are equal by 96 bits. Each bucket answers every block with one bit per hash, set if another block has it too. The block then marks its windows, merges them into maximal
intervals and cuts the words they cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 35
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)  # odd, so it has an inverse modulo 2**64
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)  # odd as well, the base of the check
BLOCK_BYTES = 1 << 24  # text of a block
BUCKET_WINDOWS = 1 << 22  # windows of a bucket
CACHE_WORDS = 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sums(w: np.ndarray, base: np.uint64, size: int) -> np.ndarray:
    """Of each window, modulo 2**64: sum of w[i+j] * base**(size-1-j), from one running sum over the document."""
    n = len(w)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    total = np.r_[np.uint64(0), np.cumsum(w * _powers(inverse, n), dtype=np.uint64)]
    h = (total[size:] - total[:-size]) * (_powers(base, n - size + 1) * _powers(base, size)[-1])
    # A last mix spreads the sums evenly over all bits, one to one.
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def window_hashes(words: list[bytes], known: dict[bytes, int], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and a 32-bit check of each window. The check sums the words' hashes after a shift that keeps the two sums apart."""
    n = len(words)
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    return _sums(w, BASE, size), (_sums(w ^ (w >> np.uint64(29)), SECOND, size) >> np.uint64(32)).astype(np.uint32)


def _grouped(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal windows together, and in this order, whether a window equals the one before it."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    same = h[1:] == h[:-1]
    apart = c[1:] != c[:-1]
    if (same & apart).any():  # different windows with one hash
        order = np.lexsort((checks, hashes))
        h, c = hashes[order], checks[order]
        same, apart = h[1:] == h[:-1], c[1:] != c[:-1]
    return order, np.r_[np.zeros(min(len(h), 1), bool), same & ~apart]


def packed(values: np.ndarray) -> bytes:
    """Sorted hashes by their differences, in six bytes each where they fit."""
    gaps = np.diff(values, prepend=np.uint64(0))
    if len(gaps) > 1 and int(gaps[1:].max()) < 1 << 48:
        rest = gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        return b"6" + values[:1].astype("<u8").tobytes() + np.ascontiguousarray(rest).tobytes()
    return b"8" + values.astype("<u8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if raw[:1] == b"8":
        return np.frombuffer(raw, "<u8", offset=1).astype(np.uint64)
    first = np.frombuffer(raw, "<u8", 1, 1)
    rest = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, 6)
    gaps = np.zeros((len(rest) + 1, 8), np.uint8)
    gaps[1:, :6] = rest
    gaps = gaps.view("<u8").ravel().astype(np.uint64)
    gaps[0] = first[0]
    return np.cumsum(gaps, dtype=np.uint64)


def _ordered(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a block in an order of their own, so that every reading of the block agrees. Equal rows may swap."""
    ids = table.column("doc_id").to_pylist()
    texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
    return [ids[k] for k in order], [texts[k] for k in order]


def _block_windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    known = _Hashes()
    each = [window_hashes(t.split(), known, size) for t in texts]
    hashes = np.concatenate([np.empty(0, np.uint64), *(h for h, _ in each)])
    return hashes, np.concatenate([np.empty(0, np.uint32), *(c for _, c in each)]), [len(h) for h, _ in each]


def _cuts(values: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits buckets begins in sorted hashes, and the end."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.r_[np.searchsorted(values, edges), len(values)]


def _sender(bits: int, size: int):
    def send(key, table):
        hashes, checks, _ = _block_windows(_ordered(table)[1], size)
        order, same = _grouped(hashes, checks)
        first = order[~same]
        values, checks = hashes[first], checks[first].astype("<u4")
        cuts = _cuts(values, bits)
        full = np.flatnonzero(np.diff(cuts))
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "block": pa.array(np.full(len(full), key[0].as_py()), pa.int64()),
            "hashes": pa.array([packed(values[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
            "checks": pa.array([checks[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
        })

    return send


def _answer(key, table):
    lists = [unpacked(raw) for raw in table.column("hashes").to_pylist()]
    checks = np.concatenate([np.frombuffer(raw, "<u4") for raw in table.column("checks").to_pylist()])
    order, same = _grouped(np.concatenate(lists), checks)
    shared = np.empty(len(order), bool)
    shared[order] = same | np.r_[same[1:], False]
    ends = np.cumsum([len(x) for x in lists])
    return pa.table({
        "block": table.column("block"),
        "bucket": table.column("bucket"),
        "bits": pa.array([np.packbits(shared[e - len(x) : e]).tobytes() for x, e in zip(lists, ends)], pa.binary()),
    })


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])
OUT_SQL = "doc_id long, n_words long, n_removed long, kept string, spans array<array<long>>"
DIGEST = pa.schema([*list(OUT)[:3], ("kept_sha256", pa.string())])
DIGEST_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _remover(bits: int, size: int, digest: bool):
    def remove(docs, answers):
        ids, texts = _ordered(docs)
        hashes, checks, sizes = _block_windows(texts, size)
        order, same = _grouped(hashes, checks)
        number = np.cumsum(~same) - 1
        place = np.empty(len(order), np.int64)
        place[order] = number
        again = np.bincount(number) > 1
        values = hashes[order[~same]]
        cuts = _cuts(values, bits)
        for bucket, raw in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
            a, b = cuts[bucket], cuts[bucket + 1]
            again[a:b] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=int(b - a)).view(bool)
        marked = again[place] if len(place) else np.empty(0, bool)
        rows, at = [], 0
        for doc, text, many in zip(ids, texts, sizes):
            words = text.split()
            n = len(words)
            mine = marked[at : at + many]
            at += many
            spans: list[list[int]] = []
            if mine.any():
                step = np.zeros(n + 1, np.int64)
                step[:many] += mine
                step[size : size + many] -= mine
                gone = np.r_[False, step.cumsum()[:n] > 0, False]
                edges = np.flatnonzero(gone[1:] != gone[:-1])
                spans = edges.reshape(-1, 2).tolist()
                kept, last = [], 0
                for a, b in spans:
                    kept += words[last:a]
                    last = b
                words = kept + words[last:]
            left = b" ".join(words)
            rows.append((doc, n, n - len(words), hashlib.sha256(left).hexdigest()) if digest else (doc, n, n - len(words), left.decode("utf-8", "replace"), spans))
        schema = DIGEST if digest else OUT
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    return remove


def removed(docs: DataFrame, window: int = WINDOW, digest: bool = False, block_bytes: int = BLOCK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (what is left, words joined by one space) and ``spans`` (the maximal
    intervals of words removed); with ``digest`` the SHA-256 of ``kept`` stands for the last two.

    A word goes if a window over it starts anywhere else too. Null texts are empty; texts shorter than a window
    stay whole; equal rows are occurrences of their own. Windows are equal if 96 bits of two hashes are: among n windows
    about n * n / 2**97 pairs are taken for equal that are not. Texts are counted first, only to choose how many blocks and buckets there are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    bits = max(0, (max(1, total // 6) // bucket_windows).bit_length())
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    sent = dealt.groupBy("block").applyInArrow(_sender(bits, window), "bucket long, block long, hashes binary, checks binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block long, bucket long, bits binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remover(bits, window, digest), DIGEST_SQL if digest else OUT_SQL)




SQL = rf"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select k, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) as h from (select k, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d)),
gone as (select distinct k, unnest(range(i, i + {WINDOW})) as place from (select k, i from x qualify count(*) over (partition by h) > 1)),
words as (select k, unnest(w) as word, generate_subscripts(w, 1) as place from d),
kept as (select k, count(*) as n, string_agg(word, ' ' order by place) as text from words anti join gone using (k, place) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (k)
"""
