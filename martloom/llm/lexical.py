"""Ranked lexical search by the Best Position Algorithm.

Documents are read once for the query terms they hold and written as rows of terms and counts. Corpus numbers follow from
these rows. Then each task takes some documents as a shard, sorts its impact lists (one per term, the highest impact
first) and answers every query: lists are read downwards together, each document met is looked up directly in all lists
of the query, and every place so seen is marked. The best position of a list is the last one before its first place
not yet seen; no document not met can score more than the impacts there together. As soon as that sum is strictly below the k-th
score the shard is done, ties included. The best of all shards are ranked again.

Queries come in blocks of a bounded number of terms, one pass over the rows each; a block is all that the driver and a task hold of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martloom.llm.common import UPPER, coded_words, in_slices, lower_ascii, whole_text, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MOST = 10  # documents of a query
BLOCK_TERMS = 200_000  # terms of the queries answered in one pass
SHARD_POSTINGS = 2_000_000
FIRST_DEPTH = 16  # places of a list read at first; each round reads twice as many
TEXT_BYTES = 1 << 22
# ASCII letters, lower-cased, and digits stay, as do bytes beyond ASCII; all others part terms.
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), UPPER.lower().encode()))
_END = b"\xff"  # no byte of UTF-8


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def _indexer(numbers: dict[bytes, int]):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in in_slices(batches, TEXT_BYTES):
            texts = [(t or b"").translate(_BYTES) for t in few.column(1).cast(pa.binary()).to_pylist()]
            placed, words = coded_words(b"".join(t + b" " + _END + b" " for t in texts))
            ends = np.flatnonzero(placed == words.index(_END))
            sizes = np.diff(ends, prepend=-1) - 1
            number = np.array([numbers.get(w, -1) for w in words], np.int64)[placed]
            here = np.flatnonzero(number >= 0)
            doc = np.searchsorted(ends, here)
            both, tfs = np.unique(doc * len(numbers) + number[here], return_counts=True)
            offsets = pa.array(np.searchsorted(both, np.arange(len(texts) + 1) * len(numbers)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (both % max(len(numbers), 1), tfs)]
            yield pa.record_batch([few.column(0), pa.array(sizes), *lists], schema=schema)

    return index


class ImpactLists:
    """The lists of one shard. Documents are numbered in the order of ``n``."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int):
        self.n_docs = n_docs
        by_doc = np.lexsort((doc, term))
        self._doc, self._impact, term = doc[by_doc], impact[by_doc], term[by_doc]
        self._falling = np.lexsort((self._doc, -self._impact, term))  # places of the by-document order, by falling impact within a term
        self._place = np.empty(len(term), np.int64)
        self._place[self._falling] = np.arange(len(term))
        names, begins = np.unique(term, return_index=True)
        self._span = dict(zip(names.tolist(), zip(begins.tolist(), [*begins[1:].tolist(), len(term)])))

    def best(self, terms: list[int], most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents met and their scores, among them all with a score not below the ``most``-th highest, and the places read of each list."""
        spans = [self._span[t] for t in terms if t in self._span]
        seen = [np.zeros(b - a, bool) for a, b in spans]
        best = [0] * len(spans)  # contiguous places seen
        met = np.zeros(self.n_docs, bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, FIRST_DEPTH
        longest = max((b - a for a, b in spans), default=0)
        while depth < longest:
            some = np.concatenate([self._doc[self._falling[a + depth : min(a + depth + step, b)]] for a, b in spans if a + depth < b])
            new = np.unique(some[~met[some]])
            met[new] = True
            score = np.zeros(len(new), np.int64)
            for (a, b), marks in zip(spans, seen):
                at = np.minimum(np.searchsorted(self._doc[a:b], new), b - a - 1)
                held = self._doc[a:b][at] == new
                score[held] += self._impact[a:b][at[held]]
                marks[self._place[a:b][at[held]] - a] = True
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score])
            depth, step = depth + step, 2 * step
            beyond = 0  # what a document not met could have at most
            for k, ((a, b), marks) in enumerate(zip(spans, seen)):
                rest = marks[best[k] :]
                ahead = int(rest.argmin()) if len(rest) else 0
                best[k] = len(marks) if len(rest) and rest[ahead] else best[k] + ahead
                if best[k] < len(marks):
                    beyond += int(self._impact[self._falling[a + best[k] - 1]])
            if len(scores) >= most and np.partition(scores, len(scores) - most)[len(scores) - most] > beyond:
                break
        return docs, scores, min(depth, longest)


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 100 - 90 + (90 * n * documents) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _searcher(queries: list[list[int]], weights: np.ndarray, documents: int, length: int, most: int, limit: int):
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def answered(held: list[tuple]) -> pa.RecordBatch:
        ids, n, sizes, term, tf = (np.concatenate(x) for x in zip(*((i, n, s, t, f) for _, i, n, s, t, f in held)))
        null = np.concatenate([h[0] for h in held])
        doc = np.repeat(np.arange(len(n)), sizes)
        impact = impacts(tf, n[doc], weights[term], documents, length)
        some = impact > 0
        lists = ImpactLists(doc[some], term[some], impact[some], len(n))
        out = []
        for number, terms in enumerate(queries):
            docs, scores, _ = lists.best(terms, most)
            order = np.lexsort((ids[docs], null[docs], -scores))[:most]
            out += [(number, None if null[d] else int(ids[d]), int(s)) for d, s in zip(docs[order], scores[order])]
        return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            ids = batch.column(0)
            terms, tfs = batch.column(2), batch.column(3)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            sizes = np.diff(terms.offsets.to_numpy())
            flat = [x.flatten().to_numpy().astype(np.int64) for x in (terms, tfs)]
            held.append((null, ids.fill_null(0).to_numpy(), batch.column(1).to_numpy(), sizes, *flat))
            many += len(flat[0])
            if many >= limit:
                yield answered(held)
                held, many = [], 0
        if many:
            yield answered(held)

    return search


def _block(rows: DataFrame, queries: list[tuple[str, list[str]]], most: int, shard: int) -> DataFrame | None:
    numbers = {t: k for k, t in enumerate(sorted({t for _, terms in queries for t in terms}))}
    coded = {t.encode("utf-8", "surrogatepass"): k for t, k in numbers.items()}
    index = written(rows.mapInArrow(_indexer(coded), "doc_id long, n long, terms array<int>, tfs array<int>"))
    documents, length = index.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    held = np.zeros(len(numbers), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a block's terms
        held[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    asked = [[numbers[t] for t in terms] for _, terms in queries]
    return index.mapInArrow(_searcher(asked, weights, documents, length, most, shard), "query int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, most: int = MOST, block_terms: int = BLOCK_TERMS, shard: int = SHARD_POSTINGS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of each item's ``most`` highest-scoring rows of ``docs`` with a score above 0.

    Equal scores rank by ascending id, null ids last; repeated rows are documents of their own, with ranks of their own. Null and
    empty texts hold no term and do not count as documents; items without a term have no row. Items with the same
    terms are answered once and repeated items get the same rows. Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select("item_id", F.array_sort(F.array_distinct(terms_of(whole_text()))).alias("terms")).filter(F.size("terms") > 0)
    asked = asked.withColumn("__key", F.sha2(F.concat_ws(" ", "terms"), 256))
    queries = asked.groupBy("__key").agg(F.any_value("terms").alias("terms"))
    total = queries.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    blocks = -(-total // block_terms)
    out = spark.createDataFrame([], "__key string, rank int, doc_id long, score long")
    for block in range(blocks):
        few = queries.filter(F.pmod(F.xxhash64("__key"), F.lit(blocks)) == block).collect()
        found = _block(rows, [(r["__key"], r["terms"]) for r in few], most, shard) if few else None
        if found is None:
            continue
        order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        keys = spark.createDataFrame([(k, r["__key"]) for k, r in enumerate(few)], "query int, __key string")
        out = out.union(top.join(keys, "query").select("__key", "rank", "doc_id", "score"))
    return asked.select("__key", "item_id").join(out, "__key").select("item_id", "rank", "doc_id", "score")


SQL = rf"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}') as t from documents),
i as (select row_number() over () as item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}')) as t from benchmark),
q as (select item, item_id, unnest(t) as term from i),
c as (select cast(count(*) as bigint) as docs, cast(sum(len(t)) as bigint) as length from d where len(t) > 0),
p as (select k, doc_id, cast(n as bigint) as n, term, cast(count(*) as bigint) as tf from (select k, doc_id, len(t) as n, unnest(t) as term from d)
  where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as weight from (select term, count(*) as df from p group by 1), c),
x as (select k, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))) as impact from p join w using (term), c),
s as (select item, item_id, k, doc_id, cast(sum(impact) as bigint) as score from x join q using (term) group by all)
select item_id, cast(row_number() over (partition by item order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0
qualify rank <= {MOST}
"""
