"""Lyndon arrays and runs against their definitions."""

from __future__ import annotations

import random

import brute
import numpy as np
from pyspark.sql import functions as F
from test_edges import EXTRA, ROWS

from martloom.llm import periodic


def sequences(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        n, k = rng.randrange(0, 60), rng.choice((1, 2, 2, 3, 5, 40))
        codes = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.4:
            p, a = rng.randrange(1, 8), rng.randrange(n)
            codes = [codes[i] if i < a else codes[a + (i - a) % min(p, n - a)] for i in range(n)]
        yield codes * rng.choice((1, 1, 1, 2, 3))


def test_lyndon_lengths():
    for codes in sequences(1, 500):
        assert periodic.lyndon_lengths(codes) == brute.lyndon(codes)


def test_runs():
    some = list(sequences(2, 400))
    for least in (2, 12):
        got = periodic.runs([np.array(c, np.int64) for c in some], least)
        assert [[tuple(r) for r in rows.tolist()] for rows in got] == [brute.word_runs(c, least) for c in some]
    fibonacci = "a"
    for a, b in ((None, "ab"),):
        fibonacci, other = b, fibonacci
        while len(fibonacci) < 300:
            fibonacci, other = fibonacci + other, fibonacci
    codes = [ord(c) for c in fibonacci]
    assert [tuple(r) for r in periodic.runs([np.array(codes)])[0].tolist()] == brute.word_runs(codes)


def test_documents_of_any_kind(spark):
    rng = random.Random(5)
    texts = [" ".join(map(str, c)) for c in sequences(3, 150)]
    rows = [(rng.randrange(10**6), t, "en", "x") for t in texts] + [*ROWS, (77, "z " * 3000, "en", "x"), (78, "a b c\n" * 500 + "a b", None, None), (None, "q " * 50, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate((*EXTRA, "runs", "start", "length")))).repartition(3)
    small = [r for r in rows if len(r[1] or "") < 5000]
    split = {k: brute.WORD.findall(t or "") for k, (_, t, *_) in enumerate(small)}
    want = sorted((brute.run_row(d, brute.planted(d, split[k]) if d is not None else split[k]) for k, (d, *_) in enumerate(small)), key=str)
    ids = {r[0] for r in rows if len(r[1] or "") >= 5000}
    assert sorted((tuple(r) for r in periodic.report(docs).collect() if r["doc_id"] not in ids), key=str) == want
    found = {r["doc_id"]: r for r in periodic.found(docs).filter("doc_id in (77, 78)").collect()}
    assert [tuple(r) for r in found[77]["runs"]] == [(0, 3000, 1)] and found[77]["collapsed"] == "z"
    assert [tuple(r) for r in found[78]["runs"]] == [(0, 1502, 3)] and found[78]["collapsed"] == "a b c"
    assert periodic.report(docs.limit(0)).count() == 0 and periodic.found(docs.limit(0)).count() == 0


def test_runs_next_to_each_other_and_across_documents():
    texts = [b"a b " * 8 + b"c", b"c " * 12, b"c " * 11, b"c", b"x y " * 3 + b"x y z " * 4, b""]
    rows = {i: ([tuple(r) for r in found.tolist()], b" ".join(words)) for i, found, words in periodic.documents_runs(list(range(6)), texts)}
    for i, t in enumerate(texts):
        assert rows[i][0] == brute.word_runs(t.decode().split())
    assert rows[1] == ([(0, 12, 1)], b"c") and rows[2] == ([], b" ".join([b"c"] * 11))
