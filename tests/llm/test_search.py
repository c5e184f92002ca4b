"""The Best Position Algorithm against scoring every document."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import EXTRA, LONG, ROWS

from martloom.llm import lexical

ITEMS = [
    (1, "a b c a zzz"), (1, "a b c a zzz"), (2, "C, a; B!"), (3, None), (4, "…"), (5, "--- \t"), (6, "twice ID here"), (None, "s1 s59 w3 Üñí x"), (7, LONG), (8, "zzz"),
]


def key(r):
    return str(r[0]), r[1], -r[3], str(r[2])


@pytest.mark.parametrize("sizes", [(200_000, 2_000_000), (3, 5)])
def test_nulls_ties_repeats_and_blocks(spark, sizes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate((*EXTRA, "n", "terms", "rank", "query", "term")))).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("terms", F.lit(1)).withColumn("__key", F.lit(2))
    block, shard = sizes
    got = lexical.ranked(docs, items, block_terms=block, shard=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute.search([(d, t) for d, t, *_ in ROWS], ITEMS)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_nothing_to_search(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).count() == 0 and lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(docs.filter("text is null"), items).count() == 0


def test_lists_stop_early_and_lose_nothing():
    rng = np.random.default_rng(4)
    early = 0
    for _ in range(60):
        n_docs, n_terms, many = int(rng.integers(1, 400)), int(rng.integers(1, 6)), int(rng.integers(1, 12))
        held = rng.random((n_terms, n_docs)) < rng.random((n_terms, 1))
        impact = np.where(held, rng.integers(1, rng.choice((3, 10**6)), (n_terms, n_docs)), 0)
        term, doc = np.nonzero(held)
        lists = lexical.ImpactLists(doc, term, impact[term, doc], n_docs)
        docs, scores, read = lists.best([*range(n_terms), 99], many)
        total = impact.sum(axis=0)
        assert (total[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
        least = np.sort(total)[::-1][:many].min()
        assert {d for d in range(n_docs) if total[d] >= max(least, 1)} <= set(docs.tolist())
        early += read < held.sum(axis=1).max()
    assert early > 5


def test_generated_texts(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.choice((5, 30, 60))]) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    items = [(i, " ".join(rng.sample(vocabulary, rng.randrange(1, 12)))) for i in range(20)]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shard=700)
    assert sorted(map(tuple, got.collect())) == sorted(brute.search(docs, items))
