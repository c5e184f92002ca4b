"""The registered queries over the small tables against plain Python, SQL, or held-out labels."""

from __future__ import annotations

import hashlib

import brute
import pytest
from check import compare, duck
from test_near import kept_by_all_pairs

from martloom.llm import prefix_counts, registry, secret_scan, tokens

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("select doc_id, text from documents order by doc_id").fetchall()


def rows(spark, name):
    return registry.QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, con, name):
    assert compare(spark, con, name, registry.QUERIES[name], registry.SQL[name], FOLDER) is None


def test_mix_comes_near_its_targets_and_repeats_no_text_more_than_thrice(spark, con):
    source = dict(con.execute("select doc_id, source from documents").fetchall())
    got = rows(spark, "op1_source_mix")
    taken, target, largest = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        assert r["target"] <= 3 * r["source_size"]
        taken[s], target[s] = taken.get(s, 0) + r["taken"], r["target"]
        largest[s] = max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in got)) < 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows(spark, "op1_source_mix")))


def test_url_rules_and_verdicts(spark, con):
    urls = dict(con.execute("select page_id, url from pages").fetchall())
    got = rows(spark, "op2_url_filter")
    assert sorted(r["page_id"] for r in got) == sorted(urls)
    for r in got:
        host, path = brute.url_parts(urls[r["page_id"]])
        rule, verdict = brute.url_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] == ("block" if r["score"] >= 0.5 else "allow")


def test_quality_on_held_out_labels(spark, con):
    label = dict(con.execute("select doc_id, quality from read_parquet('/root/testdata/sf0.01/labels.parquet')").fetchall())
    got = registry.op3_quality_trees(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    judged = [(r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    assert sum(p == q for p, q in judged) / len(judged) > 0.95


def test_base_secrets_agree_and_stay(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op4_secret_scan")}
    assert len(got) == len(docs)
    for doc, text in docs:
        base = brute.base_secrets(text)
        r = got[doc]
        assert r["base_sha256"] == hashlib.sha256(secret_scan.joined(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, _, k in base) for kind in ("assign", "access", "hex"))
        assert set(filter(None, secret_scan.joined(base).split(","))) <= set(r["spans"].split(","))


def test_rule_counts_and_verdicts(spark, docs, con):
    got = {r["doc_id"]: r for r in rows(spark, "op5_quality_rules")}
    for doc, text in docs:
        r = got[doc]
        n, *_, repeated = brute.counts(text)
        assert tuple(r)[1:6] == brute.counts(text)
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n) and not (r["base_failed"] and r["kept"])
    label = dict(con.execute("select doc_id, quality from read_parquet('/root/testdata/sf0.01/labels.parquet')").fetchall())
    got = {r["doc_id"]: r for r in registry.op5_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    good = [r for r in got.values() if label.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r for r in got.values() if label.get(r["doc_id"]) == 0 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) / len(good) > 0.95
    assert sum(r["kept"] for r in bad) / max(len(bad), 1) < 0.3


def test_components(spark, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op6_simhash")}
    assert got == brute.components(docs)


def test_tokens(spark, docs):
    assert sorted(map(tuple, rows(spark, "op7_token_shards"))) == brute.token_rows(docs, tokens.tokenizer_path())


def test_leaks(spark, docs, con):
    items = con.execute("select item_id, text from benchmark").fetchall()
    got = rows(spark, "op8_decontamination")
    few = [d for d in docs if d[0] % 4 == 0 or d[0] in {r["doc_id"] for r in got}]
    ids = {d for d, _ in few}
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] in ids} == brute.leaks(few, items)


def test_repeated_windows(spark, docs):
    assert sorted(map(tuple, rows(spark, "op9_substring_dedup"))) == sorted(brute.cut(docs))


def test_prefix_counts(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(prefix_counts.tokenizer_path())
    want = [(d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in docs]
    assert sorted(tuple(r)[:4] for r in rows(spark, "op12_prefix_counts")) == want


def test_periodic_runs(spark, docs):
    short = {d: t for d, t in docs if len(t or "") < 6000}
    got = [tuple(r) for r in rows(spark, "op13_periodic_runs")]
    assert len(got) == len(docs)
    want = [brute.run_row(d, brute.planted(d, brute.WORD.findall(t or ""))) for d, t in short.items()]
    assert sorted((r for r in got if r[0] in short), key=str) == sorted(want, key=str)


def test_pipeline_stages(spark, con, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, columns = docs, docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        stage(spark, kept, FOLDER).write.parquet(str(tmp_path / str(k)))
        before, kept = kept, spark.read.parquet(str(tmp_path / str(k)))
        assert kept.columns == columns
        counts.append(kept.count())
        if k < 3:  # filters only
            assert kept.subtract(before).isEmpty()
        if k == 1:  # one document of each component
            pairs = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            assert {r["doc_id"] for r in kept.collect()} == kept_by_all_pairs(pairs)
        if k == 2:
            items = con.execute("select item_id, text from benchmark").fetchall()
            assert not brute.leaks([(r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] % 3 == 0], items)
    result = C.STAGES[-1][1](spark, kept, FOLDER).collect()
    assert len(result) == counts[-1] and counts[0] > counts[1] > counts[2] > 0
    ends = sorted((r["start"], r["n_tokens"]) for r in result)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:])) and ends[0][0] == 0
