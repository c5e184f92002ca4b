"""Guessed secrets of eight to eleven characters, and words of the texts."""

from __future__ import annotations

import random
import re
import string

import pytest

from martloom.llm import secret_scan


@pytest.mark.parametrize("text", ["pwd: Xk9$mQ2!vR", "Bearer v8Kq2!xZ", "the passphrase is q7#Lw0^tBz2", "credential 'J4%rT9&c'"])
def test_short_random_values_are_reported(text):
    assert [k for _, _, k in secret_scan.spans(text)] == ["guess"]


def test_nearly_all_random_values_reach_the_threshold():
    rng = random.Random(5)
    alphabet = string.ascii_letters + string.digits + "!#$%&*?"
    for size in (8, 9, 10, 11):
        costs = [secret_scan.guess_cost("".join(rng.choice(alphabet) for _ in range(size))) for _ in range(500)]
        assert sum(c >= secret_scan.GUESS_AT for c in costs) >= 495


def by_hand(rows):
    """Spans of all texts with the words of all texts counted plainly."""
    counts, total = {}, 0
    for _, text in rows:
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in secret_scan.CONTEXT.sub(" ", text or ""))
        for word in re.split(r"[^a-z0-9_/+=]+", plain):
            if re.fullmatch("[a-z]{4,24}", word):
                counts[word], total = counts.get(word, 0) + 1, total + 1
    words = secret_scan.ranks(counts, total)
    return sorted((d, secret_scan.joined(secret_scan.spans(t, words=words))) for d, t in rows)


def test_words_of_the_texts_are_cheap(spark):
    prose = "the orchard keeps lanterns beside marble stairways in october"
    rows = [(k, prose) for k in range(5)] + [(8, "pwd: orchardlanterns"), (9, "token stairways"), (10, "pwd: zqkvbxwjh"), (11, "passphrase is orchard-marble-lanterns-stairways-october")]
    rows += [(20 + k, "pwd: zqkvbxwjh") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.scanned(docs).collect()}
    # A value that many texts hold is no word for that.
    assert (got[8]["n_guess"], got[9]["n_guess"], got[10]["n_guess"]) == (0, 0, 1)
    assert sorted((d, r["spans"]) for d, r in got.items()) == by_hand(rows)


def test_quoted_values_go_to_their_closing_quote():
    text = "passphrase: 'correct horse battery staple' and secret = \"a b\" pwd:`x9$Kq!v7Zr#2` token 'plain words here'"
    assert [v for _, _, v in secret_scan.values(text)] == ["correct horse battery staple", "x9$Kq!v7Zr#2"]
    assert all(text[a:b] == v for a, b, v in secret_scan.values(text))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_the_query_agrees_with_a_plain_scan(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((r["doc_id"], r["spans"]) for r in secret_scan.scanned(docs).collect()) == by_hand(rows)
