"""Counts of every prefix against the tokenizer."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_edges import EXTRA, LONG, ROWS

from martloom.llm import prefix_counts as P

ODD = [
    "It's  they'LL\tgo!? 12 ab12 <|endoftext|>x y<|startoftext|>", "á e ́  x y \x1cz\x85", "ΣΑΣ Σ ας", "", "…—​☃ \U0001f600", "x" * 300, "İ ﬁ ß ſ \x00 \x0b",
    "x<|endoftext|><|endoftext|>'re<|endo 'rest 're've'l'll'lx!'s '''s 'S 'VE 's's", "각각 ᄀ 가", "é" * 60, "ạ̈́" * 10, "क्षि नमस्ते ไทย",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.tokenizer_path())


@pytest.fixture(scope="module")
def counter():
    return P.Counter(P.tokenizer_path())


def of_prefixes(tokenizer, text):
    return [len(e.ids) for e in tokenizer.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]


def test_every_prefix(tokenizer, counter):
    rng = random.Random(1)
    pool = ["the", "The,", "don't", "\x1fa", "é.", "x|", "</w>", "9a", "a9!", "..", "̸", "≠", "'", "'re", "'v", "l", "e", "<|endoftext|>", "<|", "Å", "ᄀ", "ᅡ", "か", "゙", "-", " ", "ing"]
    texts = [*ODD, *("".join(rng.choice(pool) + rng.choice(("", "", " ")) for _ in range(rng.randrange(1, 14))) for _ in range(150))]
    texts += ["".join(chr(rng.randrange(33, 127)) for _ in range(rng.randrange(1, 30))) for _ in range(100)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 90))) for _ in range(100)]
    for text, got in zip(texts, counter.tables(texts)):
        assert got.tolist() == of_prefixes(tokenizer, text), text


def test_pairs_fit_just_if_merging_leaves_them(counter):
    v, rng = counter._v, random.Random(3)
    tokens = sorted(v._inside, key=lambda t: (len(t), t))[:3000]
    for _ in range(5000):
        before, token, closing = rng.choice([None, *tokens[:600]]), rng.choice(tokens), rng.random() < 0.5
        if token not in (v._closing if closing else v._inside):
            continue
        symbols, want = [*(before or ""), *token], [token] if before is None else [before, token]
        if closing:
            symbols[-1] += P.ENDS
            want[-1] += P.ENDS
        assert v.fits(before, token, closing) == (v.merged(symbols) == want)


def test_long_texts_without_spaces_and_full_caches(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "CACHE_CHARS", 50)
    counter = P.Counter(P.tokenizer_path())
    for text in ("ab" * 4000, "éx" * 1500, "!" * 3000, LONG[:20_000]):
        assert int(counter.tables([text])[0][-1]) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_stored_tables_answer_budgets(spark, tokenizer):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(2)
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate((*EXTRA, "n_tokens", "__cut"))))
    by_key = {(r["doc_id"], r["n_chars"]): r for r in P.prefix_tables(docs).collect()}
    for doc, text, *_ in ROWS:
        table = P.Prefixes(by_key[doc, len(text or "")]["prefixes"])
        some = sorted({0, 1, 2, 9, len(text or "")} & set(range(len(text or "") + 1)))
        assert [table.count(i) for i in some] == [len(tokenizer.encode((text or "")[:i], add_special_tokens=False).ids) for i in some]
        cut = table.longest(7)
        assert table.count(cut) <= 7 and (cut == len(text or "") or min(table.counts[cut + 1 :]) > 7)
    got = {(r["doc_id"], r["text"]) for r in P.truncated(docs, 3).select("doc_id", "text").collect()}
    assert P.truncated(docs, 3).columns == docs.columns and (3, None) in got and (1, "a b c ") in got and len(P.truncated(docs, 3).collect()) == len(ROWS)
    report = {(r["doc_id"], r["n_bytes"]): r for r in P.report(docs, limit=5).collect()}
    assert P.report(docs).count() == len(ROWS) and P.report(docs.limit(0)).count() == 0
    assert report[6, len(LONG)]["over_limit"] and report[6, len(LONG)]["fitting_chars"] < 20 and not report[4, 0]["over_limit"]
