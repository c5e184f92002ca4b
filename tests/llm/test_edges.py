"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from martloom.llm import chat, components, decontam, mixing, quality, rules, secret_scan, simhash, substrings, tokens, urls

LONG = " ".join(f"w{i % 997}" for i in range(40_000))
SHARED = " ".join(f"s{i}" for i in range(60))
ROWS = [
    (1, "a b c d e f g h i j k l", "en", "x"), (2, "a b c d e f g h i j k l", "en", "x"), (3, None, "en", None), (4, "", None, "x"),
    (5, " \n\t ", "en", "y"), (6, LONG, "de", "y"), (7, f"one {SHARED} two", "en", "x"), (8, f"three four {SHARED}", "fr", None),
    (None, "no id here", "en", "x"), (None, None, None, None), (9, "twice", "en", "x"), (9, "twice", "en", "x"), (10, "Üñí\u00a0x \U0001f600 y", "en", "z"),
]
DOCS = "doc_id long, text string, lang string, source string"
EXTRA = ("__size", "__row", "__score", "fp", "root", "block", "size", "score", "copies", "__h1", "kept")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(EXTRA))).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, SHARED), (2, SHARED.upper()), (3, None), (4, ""), (5, "too short an item"), (None, "a b c d e f g h i j k l")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, None), (7, 0, 1), (8, 1, 0), (9, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_mix(docs, empty):
    got = by_id(mixing.report(docs).collect())
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[3] == [(0, 62, got[8][0][2], 0)] and got[6][0][0] == 40_000
    assert [r[0] for r in got[None]] == [0, 3]
    again = mixing.emitted(docs)
    assert again.columns == docs.columns and again.count() >= 1
    assert mixing.report(empty).count() == 0 and mixing.emitted(empty).count() == 0


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1), (None, 10)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["b"] == 3 and got["c"] == 3 and got[None] == 30 and got["a"] == 76
    assert mixing.targets(spark.createDataFrame([("a", 0)], "source string, source_size long")).first()["target"] == 0


def test_urls(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/x?y#z"), (5, "https://www.example.com/en/"), (6, "x://b.net/es/"),
        (7, "x://b.net/es"), (8, "http://example.com?en/"), (9, "a://b://c/d"), (10, "http://" + "h" * 5000 + "/" + "p" * 5000), (10, "http://z.org/a\nb"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("__host", F.lit(2))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"]) for r in urls.judged(pages).collect())
    want = sorted((p, *(h := brute.url_parts(u)), brute.url_rule(*h)[0]) for p, u in rows)
    assert got == want
    assert urls.judged(pages.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "http://a.net/es/"), (2, "http://a.org/")], "page_id long, url string")
    for label, verdict in ((0, "allow"), (1, "block")):
        known = spark.createDataFrame([("http://z.org/", label), (None, label), ("x", None)], "url string, label int")
        assert [r["verdict"] for r in urls.judged(two, labelled=known).orderBy("page_id").collect()] == ["block", verdict]
    assert urls.judged(two, labelled=known.limit(0)).filter("page_id = 2").first()["verdict"] == "allow"


def test_quality(docs, empty, labels):
    got = quality.judged(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert quality.judged(empty, labels).count() == 0
    assert {r["predicted"] for r in quality.judged(docs, labels.limit(0)).collect()} == {0}
    assert quality.accepted(docs, quality.train(docs, labels)).columns == docs.columns


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.grow(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert quality.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_secrets(docs, empty):
    assert len(secret_scan.scanned(docs).collect()) == len(ROWS) and secret_scan.scanned(empty).count() == 0
    text = "é PASSWORD='hunter22' pwd: x9$Kq!v7Zr#2mPwL akia AKIA" + "Z" * 20 + " " + "ab12" * 8 + " token=abc secret = changeme123"
    found = secret_scan.spans(text)
    assert [s for s in found if s[2] != "guess"] == brute.base_secrets(text)
    assert [text[a:b] for a, b, k in found if k == "guess"] == ["x9$Kq!v7Zr#2mPwL"]


def test_guess_cost_against_all_segmentations():
    def least(value):
        cheap = secret_scan._segments(value)

        def best(i):
            return 0 if i == len(value) else min([secret_scan.BRUTE + best(i + 1), *(c + best(e) for e, c in cheap[i])])

        return best(0)

    for value in ("", "a", "password", "P4ssw0rd1", "qwerty2019", "abcabcabc", "2020-01-31x", "zzzzzzz", "hello1qaz"):
        assert secret_scan.guess_cost(value) == pytest.approx(least(value))
    assert secret_scan.guess_cost("password") < 2 < 8 < secret_scan.guess_cost("xk29vmq81l")


def test_rules(docs, empty):
    got = rules.judged(docs).collect()
    assert len(got) == len(ROWS) and rules.judged(empty).count() == 0
    want = sorted(((d, *brute.counts(t)) for d, t, *_ in ROWS), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] == 0)


def test_robust_estimates_ignore_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, rules.P)) * 2
    x[:400] += 30
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], ["__group", *rules.X])
    model = rules.fit(rows).first()
    assert np.abs(np.array(model["centre"])).max() < 0.4
    far = rows.join(rules.fit(rows), "__group").withColumn("d", rules._distance() / F.col("scale"))
    assert far.filter("d > 80").count() == 400


def test_simhash(docs, empty):
    ids = [(d, t) for d, t, *_ in ROWS if d is not None and d != 9]
    want = brute.components([*ids, (9, "twice")])
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.clustered(docs).collect()]
    assert len(got) == len(ROWS) and {(d, (f, c)) for d, f, c in got if d is not None} == set(want.items())
    assert simhash.clustered(empty).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, _, c in got})
    assert simhash.representatives(empty).count() == 0


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {0}
    for b in base:
        for _ in range(12):
            v = b
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << bit
            values.add(v)
    ordered = sorted(values)
    parent = {v: v for v in ordered}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[top(a)] = top(b)
    want = {}
    for v in ordered:
        want.setdefault(top(v), set()).add(simhash._signed(v))
    got = {}
    for r in simhash.rooted(spark.createDataFrame([(simhash._signed(v),) for v in ordered], "fp long")).collect():
        got.setdefault(r["root"], set()).add(r["fp"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(200)]
    df = spark.createDataFrame([*path, *star, (5, 5), (7, 6)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(201)}}
    assert components.components(df.limit(0)).count() == 0


def test_plain_words_are_spared_the_normalizer():
    mine = tokens.Encoder(tokens.tokenizer_path())
    whole, asked = mine._tokenizer, []

    class Watched:
        def encode_batch_fast(self, lines, **kwargs):
            asked.extend(lines)
            return whole.encode_batch_fast(lines, **kwargs)

    mine._tokenizer = Watched()
    texts = ["plain words, Here", None, "", " caf\u00e9 \u0130x don't 12 <|endoftext|>. x", "plain"]
    lengths, ids = mine.encode(pa.array(texts, pa.large_string()))
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, tokens.END_ID] for t in texts]
    assert lengths == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert not any(w in line.split() for line in asked for w in ("plain", "words", "here", "Here"))
    assert tokens._listed(pa.array(["skipped", "\u00e9", "", "b"])[1:]) == ["\u00e9".encode(), b"", b"b"] and tokens._listed(pa.array([], pa.string())) == []


def test_tokens(spark, docs, empty):
    got = [tuple(r) for r in tokens.read_documents(tokens.write_shards(docs, limit=1000)).collect()]
    want = brute.token_rows([(d, t) for d, t, *_ in ROWS if d is not None], tokens.tokenizer_path())
    before = sum(r[2] for r in got if r[0] is None)
    assert sorted(r for r in got if r[0] is not None) == [(d, s + before, n, c) for d, s, n, c in want]
    assert tokens.read_documents(tokens.write_shards(empty)).count() == 0


def test_words_stand_apart_for_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    whole, mine, rng = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(2)
    texts = [
        "It's  they'LL\tgo!? 12 ab12 <|endoftext|>x y<|startoftext|>", "a\u0301 e \u0301 \u00a0x\u2003y \x1cz\x85", "ΣΑΣ Σ ας", "", "…—\u200b☃ \U0001f600", "x" * 300,
        LONG[:5000], "İ ﬁ ß ſ \x00 \x0b",
    ]
    texts += [" ".join(rng.choice(("the", "The,", "don't", "\x1fa", "é.", "x|", "</w>", "9a", "a9!", "..", "\u0338", "=\u0338", "H\u0331")) for _ in range(50)) for _ in range(40)]
    lengths, ids = mine.encode(pa.array([*texts, None], pa.string()).slice(1))
    texts = [*texts[1:], ""]
    want = [[*whole.encode(t, add_special_tokens=False).ids, tokens.END_ID] for t in texts]
    assert lengths == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_shard_answers():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 70_000):
        ids = np.minimum(rng.geometric(0.01, n), 49_407).astype(np.uint16)
        shard = tokens.Shard(tokens.pack([None, 5], [n // 2, n - n // 2], ids))
        assert shard.doc_ids == [None, 5] and shard.ids().tolist() == ids.tolist()
        for i in rng.integers(0, n, min(n, 20)):
            token = int(ids[i])
            places = np.flatnonzero(ids == token)
            assert shard.access(int(i)) == token and shard.count(token) == len(places)
            assert shard.count(token, int(i)) == (places < i).sum()
            k = int((places < i).sum())
            assert shard.select(token, k) == i
        assert shard.count(49_000) == (ids == 49_000).sum()


def test_leaks(docs, empty, benchmark):
    got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(docs, benchmark).collect()}
    assert got == {(7, 1), (8, 1), (1, None), (2, None)}
    assert got == {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(docs, benchmark, most_broadcast=0).collect()}
    assert decontam.overlaps(empty, benchmark).count() == 0 and decontam.overlaps(docs, benchmark.limit(0)).count() == 0
    assert decontam.clean(docs, benchmark).count() == len(ROWS) - 4 and decontam.clean(docs, benchmark).columns == docs.columns


def test_leaks_with_words_replaced(spark):
    rng = random.Random(7)
    items = [(i, " ".join(f"v{rng.randrange(4000)}" for _ in range(rng.randrange(9, 40)))) for i in range(40)]
    docs = []
    for i, text in items:
        words = text.split()
        for k in rng.sample(range(len(words)), max(1, len(words) // rng.choice((4, 8, 16)))):
            words[k] = "other"
        docs.append((i, " ".join(["before"] * rng.randrange(5) + words[rng.randrange(3) :] + ["after"])))
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    want = brute.leaks(docs, items)
    assert pairs <= want
    # Whole windows of 13 words with two differences are always found.
    long = {i for i, t in items if len(t.split()) >= 13}
    assert {p for p in want if p[1] in long} <= pairs


def test_substrings(docs, empty):
    got = sorted((tuple(r) for r in substrings.removed(docs, digest=True, block_bytes=4000, bucket_windows=200).collect()), key=str)
    assert got == sorted(brute.cut([(d, t) for d, t, *_ in ROWS]), key=str)
    assert substrings.removed(empty).count() == 0
    row = substrings.removed(docs).filter("doc_id = 7").first()
    assert row["kept"] == "one two" and row["spans"] == [[1, 61]]


def test_windows_that_share_a_hash_stay_apart():
    rng = np.random.default_rng(4)
    hashes, checks = rng.integers(0, 3, 400).astype(np.uint64), rng.integers(0, 5, 400).astype(np.uint32)
    order, same = substrings._grouped(hashes, checks)
    pairs = list(zip(hashes[order].tolist(), checks[order].tolist()))
    assert sorted(order.tolist()) == list(range(400)) and not same[0]
    assert [a == b for a, b in zip(pairs, pairs[1:])] == same[1:].tolist() and (~same).sum() == len(set(pairs))
    assert substrings._grouped(hashes[:0], checks[:0])[1].tolist() == []


def test_equal_hashes_of_other_words_cut_nothing(monkeypatch):
    """All windows get one 64-bit hash; the checks alone tell them apart, within a block and between blocks."""
    whole = substrings._sums
    monkeypatch.setattr(substrings, "_sums", lambda w, base, size: whole(w, base, size) * np.uint64(base != substrings.BASE))
    texts = [[f"{a}{k}" for k in range(60)] for a in "xyz"] + [["y9"] * 3 + [f"y{k}" for k in range(10, 50)]]
    blocks = [pa.table({"doc_id": [2 * b, 2 * b + 1], "text": [" ".join(t) for t in texts[2 * b : 2 * b + 2]]}) for b in range(2)]
    sent = pa.concat_tables([substrings._sender(0, 35)((pa.scalar(b),), t) for b, t in enumerate(blocks)])
    answers = substrings._answer((pa.scalar(0),), sent)
    got = [substrings._remover(0, 35, False)(t, answers.filter(pc.equal(answers["block"], b))).to_pylist() for b, t in enumerate(blocks)]
    rows = {r["doc_id"]: r for part in got for r in part}
    assert [rows[k]["n_removed"] for k in range(4)] == [0, 41, 0, 41]
    assert rows[1]["spans"] == [[9, 50]] and rows[3]["spans"] == [[2, 43]]


def test_window_hashes_follow_their_words():
    known = substrings._Hashes()
    words = [b"a", b"b", b"a", b"b", b"c"] * 30
    h, checks = substrings.window_hashes(words, known, 7)
    windows = [tuple(words[i : i + 7]) for i in range(len(words) - 6)]
    assert len({(w, int(x)) for w, x in zip(windows, h)}) == len(set(windows)) == len(set(h.tolist())) == len(set(checks.tolist()))
    for values in (np.array([], np.uint64), np.array([3], np.uint64), np.unique(h), np.array([0, 1, 2**64 - 1], np.uint64)):
        assert substrings.unpacked(substrings.packed(values)).tolist() == values.tolist()


CHATS = [
    (1, 0, "system", "be </s> kind [INST] <<SYS>>"), (1, 1, "user", None), (1, 2, "assistant", "a[\\INST]b [\\\\/INST] <\\s>"), (2, None, None, ""), (2, 0, "tool", "x"),
    (2, 0, "tool", "x"), (3, 1, "assistant", " </s>"), (3, 0, "user", "[/INST] [INST] [/INST]\n<</SYS>>\n"), (None, 0, "we[ROLE]ird[/ROLE] ", "t"), (4, 0, "assistant", LONG),
]


def test_chats(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    assert set(got) == {-1, 1, 2, 3, 4, None} and got[2]["n_turns"] == 3
    assert got[4]["loss_chars"] == len(LONG) and got[2]["loss_chars"] == 0
    assert [r["conv_id"] for r in chat.report(df.limit(0)).collect()] == [-1]


def test_chat_round_trip():
    for _, _, role, text in [*CHATS, (0, 0, "user", "<" * 5 + "/s>"), (0, 0, "assistant", "["), (0, 0, "x" * 10, "\\"), (0, 0, "[", "/INST]")]:
        out, start, end = chat.render(role, text)
        assert chat.parse(out) == [(role or "", text or "", start, end)]
    pieces = [chat.render(r, t)[0] for _, _, r, t in CHATS]
    assert [(r, t) for r, t, _, _ in chat.parse("".join(pieces))] == [(r or "", t or "") for _, _, r, t in CHATS]
    for bad in ("x", "[INST] a", "<s> a <s> b </s>"):
        with pytest.raises(ValueError):
            chat.parse(bad)
