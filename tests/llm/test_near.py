"""The pipeline's near-duplicates against all pairs of shingle sets."""

from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import EXTRA, ROWS

from martloom.llm import near


def kept_by_all_pairs(rows):
    sets, parent = {}, {}
    for doc, text in rows:
        words = (text or "").lower().split()
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        parent[doc] = doc

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        same = len(sets[a] & sets[b])
        if sets[a] == sets[b] or (same and 5 * same >= 4 * (len(sets[a]) + len(sets[b]) - same)):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d for d in sets if top(d) == d}


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(9)
    rows = [(1000, None), (1001, ""), (1002, "Two words"), (1003, "two WORDS"), (1004, "two other")]
    for group in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((20, 60, 200)))]
        for k in range(12):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randrange(1 + len(words) // 20)):
                words[at] = f"x{rng.randrange(3000)}"
            rows.append((group * 20 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got) == sorted(kept_by_all_pairs(rows))


def test_near_copies_of_the_tables_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()}
    assert got == kept_by_all_pairs([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_bands_reach_pairs_at_the_limit():
    rng = random.Random(4)
    for _ in range(300):
        common = [rng.getrandbits(64) for _ in range(80)]
        a, b = (np.unique(np.array(common + [rng.getrandbits(64) for _ in range(10)], np.uint64)) for _ in range(2))
        assert set(near.bands(a)) & set(near.bands(b))


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_sets_missed_by_the_leader_meet_in_their_first_differences():
    rng = random.Random(6)
    met = 0
    for _ in range(4000):
        base = {rng.getrandbits(64) for _ in range(rng.choice((12, 40, 120)))}
        change = lambda s, k: set(rng.sample(sorted(s), max(1, len(s) - rng.randrange(k + 1)))) | {rng.getrandbits(64) for _ in range(rng.randrange(k + 1))}
        parent = change(base, rng.choice((2, len(base) // 4)))
        a, b = change(parent, len(base) // 8), change(parent, len(base) // 8)
        arrays = [np.array(sorted(x), np.uint64) for x in (base, a, b)]
        (alike_a, first_a, _), (_, first_b, found_b) = near.compared(arrays[0], arrays[1]), near.compared(arrays[0], arrays[2])
        assert alike_a == alike(base, a)
        if not alike_a and alike(a, b):
            met += 1
            assert set(first_a.tolist()) & set(first_b[:found_b].tolist())
    assert met > 300


def crowd(kind, many):
    """Copies of one text with 0 to 8 of 120 words changed: most are alike to few others or none."""
    rng = random.Random(many)
    base = [f"w{k}" for k in range(120)]
    rows, last = [], base
    for k in range(many):
        words = list(last if kind == "chained" and rng.random() < 0.7 else base)
        for at in sorted(rng.sample(range(len(words)), min(rng.randrange(9), len(words))), reverse=True):
            if kind == "deleted":
                del words[at]
            else:
                words[at] = f"x{rng.randrange(10**6)}"
        last = words if rng.random() < 0.9 else base
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("kind", ["deleted", "chained"])
def test_crowds_of_near_copies_keep_what_all_pairs_keep(spark, kind):
    rows = crowd(kind, 150)
    got = near.representatives(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()
    assert {r["doc_id"] for r in got} == kept_by_all_pairs(rows)


def test_crowds_of_near_copies_take_pairs_in_proportion(spark, monkeypatch):
    judged, write = [], near.written

    def counted(df):
        out = write(df)
        if "alike" in out.columns:
            judged.append(out.count())
        return out

    monkeypatch.setattr(near, "written", counted)
    for many in (500, 2000):
        rows = crowd("replaced", many)
        judged.clear()
        got = near.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("doc_id").collect()
        assert sum(judged) < 1.5 * many
        if many == 500:
            assert {r["doc_id"] for r in got} == kept_by_all_pairs(rows)


def test_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate((*EXTRA, "node", "bands", "group", "leader", "alike")))).repartition(3)
    kept = near.representatives(docs)
    assert kept.columns == docs.columns
    # One each of the equal texts, the texts without words, the two around one passage, and the repeated row.
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 6, 7, None, 9, 10], key=str)
    assert near.representatives(docs.limit(0)).count() == 0


def test_simhash_classes_are_checked_and_spare_later_groups(spark, monkeypatch):
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*base[:k], *base[k + 1 :]])) for k in range(0, 80, 2)] + [(1000 + k, f"other text {k} " * 9) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    judged, mates, write, pairs = [], [], near.written, near.classmates

    def counted(df):
        out = write(df)
        if "alike" in out.columns:
            judged.append(out.count())
        return out

    def noted(nodes):
        out = write(pairs(nodes))
        mates.append(out.count())
        return out

    monkeypatch.setattr(near, "written", counted)
    monkeypatch.setattr(near, "classmates", noted)
    assert {r["doc_id"] for r in near.representatives(docs).select("doc_id").collect()} == kept_by_all_pairs(rows)
    # One check a set with its class's head connects the crowd; no band compares its sets again.
    assert mates == [39] and not judged
    monkeypatch.setattr(near, "classmates", lambda nodes: pairs(nodes).limit(0))
    assert {r["doc_id"] for r in near.representatives(docs).select("doc_id").collect()} == kept_by_all_pairs(rows)
    assert judged


def test_unlike_sets_of_a_simhash_class_stay_apart(spark, monkeypatch):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(6)]
    monkeypatch.setattr(near, "majority", lambda grams: 7)
    nodes = spark.createDataFrame([(k, 7) for k in range(6)], "node long, fp long")
    assert near.classmates(nodes).count() == 5
    assert near.representatives(spark.createDataFrame(rows, "doc_id long, text string")).count() == 6
