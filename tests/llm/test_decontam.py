"""Seeds of short benchmark items."""

from __future__ import annotations

from itertools import combinations

import brute
import pytest

from martloom.llm import decontam


@pytest.mark.parametrize("size", [9, 10, 11, 12, 13])
def test_masks_miss_no_placement(size):
    masks = decontam.MASKS + (decontam.SHORT_MASKS if size < decontam.WINDOW else ())
    seeds = [{at + p for p in mask} for mask in masks for at in range(size - mask[-1])]
    places = combinations(range(size), size - -(-4 * size // 5))
    assert all(any(not seed & set(other) for seed in seeds) for other in places)


def test_short_items_with_every_allowed_replacement(spark):
    items, docs = [], []
    for size in range(1, 9):
        words = [f"e{size}x{k}" for k in range(size)]
        items.append((size, " ".join(words)))
        docs.append((len(docs) + 1, f"x {' '.join(words).upper()} y {' '.join(words)}"))
        docs.append((len(docs) + 1, f"x {' '.join(['other', *words[1:]])} {' '.join(words[:-1])} z"))
    for size in (9, 10, 11, 12, 14):
        words = [f"s{size}w{k}" for k in range(size)]
        items.append((size, " ".join(words)))
        for other in combinations(range(size), min(size, 13) - -(-4 * min(size, 13) // 5)):
            docs.append((len(docs) + 1, "before the " + " ".join("other" if k in other else w for k, w in enumerate(words)) + " after it"))
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute.leaks(docs, items)
    assert len(brute.leaks(docs, items)) == len(docs) - 8
    every = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(*every, most_broadcast=0).collect()} == brute.leaks(docs, items)
    kept = {r["doc_id"] for r in decontam.clean(*every).collect()}
    assert kept == {d for d, _ in docs} - {d for d, i in brute.leaks(docs, items) if i >= decontam.LEAST_LEAK}
