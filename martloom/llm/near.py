"""Near-duplicates by word shingles: SimHash classes first, MinHash bands for pairs beyond their radius; whole sets decide.

Documents are alike if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. SimHash fingerprints of the sets meet by ball
hashing, as in :mod:`martloom.llm.simhash`, and each set of a class is checked against one of them. Fingerprints at 0.8 differ in ten of 64 bits, beyond the
reach of a ball, so two sets also meet if they share one of 40 bands of five minima: a pair at 0.8 shares none with a
chance of 1.3e-7, a pair at 0.1 shares one with 0.0004. Groups whose sets are connected already are left out there.

Sets that share a band are not compared with each other but with their leader, the one whose bands most others share. Let d(A) be the shingles in which
A differs from its leader. If A is not alike to the leader but alike to another set B of the group, d(A) and d(B) have more than half of d(B)
in common, and at least |d(A)| - |A| / 4:

* |A Δ B| <= (|A| + |B|) / 9 says that A and B are alike, |d(A)| > (|A| + |leader|) / 9 that A is not alike to the leader;
* |A Δ B| = |d(A)| + |d(B)| - 2 |d(A) ∩ d(B)|, and |B| <= 5/4 |A|;
* if A is far from the leader, so is B, which bounds |d(B)| from below and the common part with it.

So, with all differences in one order, the first ones of A and of B, as many as leave out less than that, share one (a prefix filter). Shingles that the leader lacks
come first, since copies are changed in ways of their own. Sets that share such a difference are a new group with a leader of its own, and
so on until no group has a set left that could have been missed. A round takes one comparison per set and leader; to end soon where copies
are changed alike, rounds take four times as many leaders each, so their number is that of the logarithm of the largest group.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martloom.llm.common import row_key, written
from martloom.llm.components import components
from martloom.llm.simhash import majority, rooted, rows_of

SHINGLE = 5
BANDS, MINIMA = 40, 5
CHUNK = 512
_RANDOM = np.random.default_rng(42)
XOR, TIMES = (_RANDOM.integers(0, 1 << 64, BANDS * MINIMA, np.uint64)[:, None] for _ in range(2))
TIMES = TIMES | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the whole text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a : b - 1]) for a, b in zip(starts, starts[SHINGLE:])], np.uint64))


def bands(grams: np.ndarray) -> list[int]:
    """Hashes of the bands of minima, each with its own seed."""
    if not len(grams):
        return []
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), CHUNK):
        np.minimum(least, ((grams[at : at + CHUNK] ^ XOR) * TIMES).min(axis=1), out=least)
    raw, step = least.tobytes(), 8 * MINIMA
    return np.array([xxhash.xxh64_intdigest(raw[b * step : (b + 1) * step], b) for b in range(BANDS)], np.uint64).astype(np.int64).tolist()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), np.concatenate([np.empty(0, np.int64), *parts]))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


# Texts and sets pass as Arrow, one text at a time, so that a worker holds no second copy of a batch.
def _sketches(texts: pa.Array) -> pa.Array:
    nodes, sizes, fps, keys = [], [], [], []
    for text in texts:
        grams = shingles(text.as_py())
        nodes.append(xxhash.xxh64_intdigest(grams.tobytes()) if len(grams) else 0)
        sizes.append(len(grams))
        fps.append(majority(grams))
        keys.append(np.array(bands(grams), np.int64))
    return pa.StructArray.from_arrays([_signed(nodes), pa.array(sizes, pa.int64()), _signed(fps), _lists(keys)], ["node", "size", "fp", "bands"])


def _sets(texts: pa.Array) -> pa.Array:
    return _lists([shingles(t.as_py()).view(np.int64) for t in texts])


def compared(leader: np.ndarray, own: np.ndarray) -> tuple[bool, np.ndarray, int]:
    """Whether two sorted sets are alike, and the first differences by which the second one meets others; the third value says by how many of these
    other sets may find it. A set that is alike to the leader seeks none itself and keeps just those."""
    return _judged(len(leader), len(own), np.setdiff1d(own, leader, True), np.setdiff1d(leader, own, True))


def _judged(size: int, n: int, more: np.ndarray, less: np.ndarray) -> tuple[bool, np.ndarray, int]:
    """:func:`compared` from the sizes of the leader and the set, what the set has more and what it lacks."""
    apart = len(more) + len(less)
    alike = 9 * apart <= size + n
    # Jaccard distance is a metric, so a set alike to one far from the leader is nearly as far: a lower bound on its differences, and so on the common ones.
    low = max(0.0, 2 * apart / (size + n + apart) - 0.2)
    least = low * (0.8 * n + size) / (2 - low)
    far = math.ceil((least + apart - n / 4) / 2 - 1e-6)
    # More than half of the differences, give or take the sizes, are common to both sets of a pair that was missed.
    found = apart - max(1, (9 * apart + size - n) // 18 + 1, far) + 1
    sought = apart - max(1, -(-(4 * apart - n) // 4), far) + 1
    many = 0 if alike else max(sought, found)
    # A missing shingle is told from an added one by its flipped bits.
    first = np.concatenate([more, ~less])[: max(found, many)]
    return alike, first.view(np.int64), max(found, 0)


COMPARED = "alike boolean, first array<long>, many long"


def _compared(sizes: pa.Array, owns: pa.Array, more: pa.Array, less: pa.Array) -> pa.Array:
    plain = lambda x: x.values.to_numpy().view(np.uint64)
    rows = []
    for size, own, a, b in zip(sizes.to_pylist(), owns.to_pylist(), more, less):
        rows.append(_judged(size, own, plain(a), plain(b)))
    return pa.StructArray.from_arrays(
        [pa.array([r[0] for r in rows], pa.bool_()), _lists([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64())], ["alike", "first", "many"]
    )


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``leader``, ``node``) with the sizes of both sets and their differences, which are taken by Spark: near copies send little to Python."""
    both = pairs.join(sets.toDF("leader", "__a"), "leader").join(sets.toDF("node", "__b"), "node")
    return both.select(
        "leader", "node", F.size("__a").alias("a"), F.size("__b").alias("b"), F.array_except("__b", "__a").alias("more"), F.array_except("__a", "__b").alias("less")
    )


def _led(members: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """``members`` (``parent``, ``group``, ``node``, ``rank``, ``hit``) under the leader of their group, its hit of the highest rank. Groups of one parent
    with the same leader are one: (``group``, ``leader``, ``node``, ``rank``, ``hit``).

    The next ``many`` - 1 hits are compared with all of their group as well, as (``leader``, ``node``), and then are no hits any more.
    """
    order = W.partitionBy("group").orderBy(F.desc("rank"), F.desc("node"))
    heads = written(members.filter("hit").select("group", "node", "rank").withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= many))
    leaders = heads.filter("__r = 1").select("group", F.col("node").alias("leader"))
    others = heads.filter("__r > 1").select("group", F.col("node").alias("leader"))
    more = members.select("group", "node").join(others, "group").filter("node <> leader").select("leader", "node")
    used = others.select("group", F.col("leader").alias("node"), F.lit(True).alias("__used"))
    led = members.join(leaders, "group").filter("node <> leader").join(used, ["group", "node"], "left")
    hit = F.max(F.col("hit") & F.isnull("__used")).alias("hit")
    return led.groupBy(F.xxhash64("parent", "leader").alias("group"), "leader", "node").agg(F.max("rank").alias("rank"), hit), more


def _sets_of(nodes: DataFrame, docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(``node``, ``set``) of the asked nodes; one text per node is read again."""
    rows = asked.join(nodes.select("node", "__best.__h1", "__best.__h2"), "node")
    texts = docs.select("text", *row_key(docs)).join(rows, ["__h1", "__h2"]).dropDuplicates(["node"])
    return written(texts.select("node", F.arrow_udf(_sets, "array<long>")("text").alias("set")))


def classmates(nodes: DataFrame) -> DataFrame:
    """(``leader``, ``node``): the sets of each SimHash class with the smallest one of it. Fingerprints are one class if they are connected by
    steps of three bits or fewer, found by ball hashing."""
    classes = nodes.select("node", "fp").join(written(rooted(nodes.select("fp").distinct())), "fp")
    # Few sets are in a class with others, and only their classes meet again.
    heads = classes.groupBy("root").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    return classes.join(heads, "root").filter("node <> leader").select("leader", "node")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``root``, the same for sets that are connected already."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` that connect all sets at 0.8 or more that share a SimHash class with their class's head or a band, directly or through others."""
    mates = written(classmates(nodes))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    # Counts are joined back rather than taken by a window, so that a band with very many sets is counted in every task.
    shared = written(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"), "key"))
    # A set ranks by the sets that its bands meet, so the text that others were made from leads them.
    ranks = shared.groupBy("node").agg(F.sum("__n").alias("rank"))
    sets = _sets_of(nodes, docs, ranks.select("node").union(mates.select("node")).union(mates.select("leader")).distinct())
    close = _both(mates, sets).filter(9 * (F.size("more") + F.size("less")) <= F.col("a") + F.col("b"))
    found = written(close.select(F.col("leader").alias("u"), F.col("node").alias("v")))
    ranked = written(shared.select("key", "node").join(ranks, "node"))
    # The sets of a band are led by the highest set that one of them shares any band with, so that bands of one crowd have one leader.
    heads = ranked.groupBy("key").agg(F.max(F.struct("rank", "node")).alias("__head"))
    tops = ranked.join(heads, "key").groupBy("node").agg(F.max("__head").alias("__top"))
    leaders = ranked.join(tops, "node").groupBy("key").agg(F.max("__top").alias("__top"))
    led = ranked.join(leaders, "key").select(F.col("__top.node").alias("leader"), "node", "rank").filter("node <> leader").distinct()
    led = led.withColumns({"group": F.xxhash64("leader"), "hit": F.lit(True)})
    # Sets that are connected already have nothing to find in each other.
    roots = components(found)
    everyone = led.select("group", "node").union(led.select("group", F.col("leader").alias("node")))
    apart = _rooted(everyone, roots).groupBy("group").agg(F.min("root").alias("__low"), F.max("root").alias("__high")).filter("__low < __high")
    led, more, leaders = led.join(apart.select("group"), "group"), None, 1
    while True:
        led = written(led.select("group", "leader", "node", "rank", "hit"))
        if led.isEmpty():
            return found
        pairs = led.select("leader", "node")
        pairs = (pairs if more is None else pairs.union(more)).distinct()
        judged = _both(pairs, sets).select("leader", "node", F.arrow_udf(_compared, COMPARED)("a", "b", "more", "less").alias("c"))
        judged = written(judged.select("leader", "node", "c.*"))
        found = found.union(judged.filter("alike").select(F.col("leader").alias("u"), F.col("node").alias("v")))
        first, leaders = leaders == 1, 4 * leaders
        if first:  # Later rounds are small, and components cost many jobs.
            roots = components(found)
        led, more = _led(written(_next(led, judged, roots, first)), leaders)


def _next(led: DataFrame, judged: DataFrame, roots: DataFrame, first: bool) -> DataFrame:
    """The groups of the next round: sets of one group that share a difference from its leader, one of them not alike to it.

    Of two sets that may have been missed, one is found by its first differences. Those that are found in the first round are the hits of their
    groups from then on: every missed pair has one, leaders are taken from them, and a group is done once it has none left.
    """
    rows = led.join(judged, ["leader", "node"])
    counts = rows.groupBy("group").agg(F.count(F.lit(1)).alias("__n"), F.min("alike").alias("__all"), F.max("hit").alias("__more"))
    open_groups = counts.filter("__n > 1 and __more and not __all").select("group")
    rest = _rooted(rows, roots).select("group", "node", "rank", "hit", "alike", "many", "root", F.posexplode("first").alias("__at", "__token")).join(open_groups, "group")
    found = F.col("__at") < F.col("many")
    members = rest.select(
        F.col("group").alias("parent"), F.xxhash64("group", "__token").alias("group"), "node", "rank", (found if first else F.col("hit")).alias("hit"),
        found.alias("__found"), (~F.col("alike")).alias("__seeks"), "root",
    )
    # A group needs a set that seeks, another one that is found, a hit, and sets that are not connected yet.
    some = members.groupBy("group").agg(
        F.count(F.lit(1)).alias("__n"), F.max("__found").alias("__f"), F.max("__seeks").alias("__s"), F.max("hit").alias("__h"),
        F.min("root").alias("__low"), F.max("root").alias("__high"),
    ).filter("__n > 1 and __f and __s and __h and __low < __high").select("group")
    # A set is in a group once, whatever the number of its rows.
    return members.join(some, "group").groupBy("parent", "group", "node").agg(F.max("rank").alias("rank"), F.max("hit").alias("hit"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per group of near-duplicates, in its columns: the one with the smallest id (null ids last), ties by the row's hash.

    Groups are connected by pairs at 0.8 or more. Texts with the same shingles meet as one; all texts without words are one group.
    """
    keys = ["__h1", "__h2"]
    sketch = F.arrow_udf(_sketches, "node long, size long, fp long, bands array<long>")
    marked = docs.select("doc_id", *row_key(docs), sketch("text").alias("__s")).select("doc_id", *keys, "__s.*")
    best = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", *keys)).alias("__best")
    nodes = written(marked.groupBy("node").agg(best, *(F.first(c).alias(c) for c in ("size", "fp")), F.first("bands").alias("bands")))
    roots = components(links(nodes, docs))
    kept = (
        nodes.select("node", "__best").join(roots, "node", "left").groupBy(F.coalesce("root", "node"))
        .agg(F.min("__best").alias("__best")).select("__best.__h1", "__best.__h2")
    )
    return rows_of(docs, kept)
