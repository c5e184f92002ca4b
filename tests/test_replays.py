"""Admission replay, redaction from a table, bucketed upserts, rows' places in files and type masks."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from martloom.operators import admission, profiling, redaction
from martloom.sources import positions, raw_csv
from martloom.sources.buckets import BucketTable


def admitted(sizes, limit):
    used, out = 0, []
    for size in sizes:
        ok = used + max(size or 0, 0) <= limit
        out.append((used, ok))
        used += max(size or 0, 0) if ok else 0
    return out


def test_steps_are_the_loop_from_every_room():
    rng = random.Random(2)
    for _ in range(300):
        limit = rng.choice((1, 5, 30, 100))
        sizes = [rng.randrange(-1, rng.choice((3, 20, 120))) for _ in range(rng.randrange(0, 25))]
        ranges = admission.steps(sizes, limit)
        assert [a for a, _ in ranges] == sorted({a for a, _ in ranges}) and len(ranges) <= limit + 1
        for room in range(limit + 1):
            left = room
            for size in sizes:
                left -= size if 0 < size <= left else 0
            assert admission.room_after(ranges, room) == left


def test_replay_agrees_with_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for k in range(900):
        session = rng.choice((1, 1, 1, 2, 3, 4, None))
        rows.append((session, k // 40, k, rng.choice((None, 0, -5, 1, 3, 10, 25, 70, 101))))
    log = spark.createDataFrame(rows, "session_id long, day long, at long, size long").withColumn("__size", F.lit("x")).repartition(4)
    for limit in (100, 3):
        got = {(r["session_id"], r["at"]): (r["used_before"], r["admitted"]) for r in admission.replay(log, F.col("size"), ["at"], F.col("day"), limit).collect()}
        assert len(got) == len(rows)
        for session in (1, 2, 3, 4, None):
            mine = [r for r in rows if r[0] == session]
            assert [got[session, r[2]] for r in mine] == admitted([r[3] for r in mine], limit)
    assert admission.replay(log.limit(0), F.col("size"), ["at"], F.col("day"), 5).count() == 0


def redacted(text, secrets):
    found = sorted((i, i + len(s)) for s in secrets if s for i in range(len(text) - len(s) + 1) if text[i : i + len(s)] == s)
    islands = []
    for a, b in found:
        if islands and a < islands[-1][1]:
            islands[-1][1] = max(islands[-1][1], b)
        else:
            islands.append([a, b])
    out, at = "", 0
    for a, b in islands:
        out, at = out + text[at:a] + "[redacted]", b
    return out + text[at:]


@pytest.mark.parametrize("alphabet", ["ab", "abcdé\U0001f600\n "])
def test_redaction_from_a_table(spark, alphabet):
    rng = random.Random(len(alphabet))
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    secrets = {word(rng.choice((2, 3, 4, 5, 6, 9, 20))) for _ in range(12)} | {word(300), word(700)}
    secrets = {s for s in secrets if not (len(alphabet) > 2 and len(s) < 3)}
    texts = [(k, word(rng.choice((0, 1, 7, 60, 255, 256, 257, 900)))) for k in range(60)]
    texts += [(100 + k, word(200) + s + word(90) + s) for k, s in enumerate(sorted(secrets))] + [(500, None), (501, "")]
    table = spark.createDataFrame([*((s,) for s in secrets), (None,), ("",), (next(iter(secrets)),)], "secret string")
    df = spark.createDataFrame(texts, "id long, text string").withColumn("__key", F.lit(1)).withColumn("__chunks", F.lit(2)).repartition(3)
    out = redaction.redact(df, "id", "text", table)
    assert out.columns == df.columns
    got = {r["id"]: r["text"] for r in out.collect()}
    assert got == {k: None if t is None else redacted(t, secrets) for k, t in texts}
    same = redaction.redact(df, "id", "text", table.limit(0))
    assert {r["id"]: r["text"] for r in same.collect()} == dict(texts)


def test_redaction_of_many_secrets(spark):
    rng = random.Random(8)
    secrets = [f"key-{rng.getrandbits(40):010x}" for _ in range(3000)]
    texts = [(k, " ".join(rng.choice((f"w{rng.randrange(50)}", rng.choice(secrets), f"key-{rng.getrandbits(40):010x}")) for _ in range(80))) for k in range(60)]
    out = redaction.redact(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame([(s,) for s in secrets], "secret string"))
    known = set(secrets)
    assert {r["id"]: r["text"] for r in out.collect()} == {k: " ".join("[redacted]" if w in known else w for w in t.split(" ")) for k, t in texts}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(400)] + [(None, "none")], "id long, value string")
    path = str(tmp_path / "t")
    kept = BucketTable(spark, path, ["id"], 16).create(rows)

    def merge(old, new):
        both = old.join(new.withColumnRenamed("value", "fresh"), old["id"].eqNullSafe(new["id"]), "full")
        return both.select(F.coalesce(old["id"], new["id"]).alias("id"), F.coalesce("fresh", "value").alias("value"))

    files = lambda: {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}
    before = files()
    edits = spark.createDataFrame([(7, "seven"), (1000, "new")], "id long, value string")
    touched = kept.upsert(edits, merge)
    after = files()
    assert 1 <= len(touched) <= 2 and {f.split("/")[0] for f in before ^ after} == {f"__bucket={b}" for b in touched}
    want = {k: f"v{k}" for k in range(400)} | {None: "none", 7: "seven", 1000: "new"}
    assert {r["id"]: r["value"] for r in kept.read().collect()} == want and kept.read().count() == len(want)
    kept.upsert(edits, merge)
    assert {r["id"]: r["value"] for r in kept.read().collect()} == want and kept.read().count() == len(want)
    now = files()
    assert kept.upsert(edits.limit(0), merge) == [] and files() == now


def test_places_in_files_do_not_depend_on_splits(spark, tmp_path):
    rng, lines = random.Random(1), []
    for k, many in enumerate((900, 0, 1, 2500)):
        rows = [f"{k}-{i},{'x' * rng.randrange(40)}" + (",more" if i % 9 == 4 else "") for i in range(many)]
        (tmp_path / f"part-{k}.csv").write_text("\n".join(["name,filler", *rows]) + "\n")
        lines += rows
    found = []
    for limit in ("64m", "3000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            df = raw_csv.read_raw_csv(spark, str(tmp_path), ["name", "filler"], positions=True)
            found.append({r["name"]: (r[positions.FILE].rsplit("/", 1)[1], r[positions.FILE_ROW], r[positions.LOAD_ROW]) for r in df.collect()})
            first = raw_csv.preview(df, [("name", "Name")], limit=3)
            assert [r["Name"] for r in first.collect()] == ["0-0", "0-1", "0-2"]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for at, line in enumerate(lines):
        name = line.split(",")[0]
        if not line.endswith(",more"):
            want[name] = (f"part-{name[0]}.csv", int(name.split("-")[1]), at)
    assert found[0] == found[1] == want


VALUES = [
    "true", "No", "0", "1", "12", "-7", "+1_000", "1.5", ".5e3", "_1.0", "inf", "NaN", "snan12", "2024-01-31", "2024/1/3", "31/12/2024", "12/31/2024", "20240131", "2024-13-01", "x", " 5 ", "",
    "NULL", "yesterday", "-inf", "1e400", "00000000", "é",
]


def test_types_from_masks_are_those_of_distinct_values(spark):
    rng = random.Random(3)
    columns = [f"c{k}" for k in range(40)] + ["id", "shop_id", "empty"]
    pools = [rng.sample(VALUES, rng.choice((1, 1, 2, 3))) for _ in columns[:-1]] + [["", "null"]]
    rows = [tuple(rng.choice(p) for p in pools) for _ in range(12)]
    df = spark.createDataFrame(rows, columns)
    counts = profiling.value_counts(df, columns, F.lit(0))
    want = {r["raw_column_name"]: r["detected_type"] for r in profiling.summarize(counts).collect()}
    got = {r["raw_column_name"]: r["detected_type"] for r in profiling.detect_types(df, columns).collect()}
    assert got == want and got["empty"] == "unknown" and got["id"] == "identifier"
    none = {r["detected_type"] for r in profiling.detect_types(df.limit(0), columns).collect()}
    assert none == {"unknown"}
    values = spark.createDataFrame([(v,) for v in VALUES], "v string").withColumn("v", profiling.meaningful(F.col("v"))).filter("v is not null")
    tests = {"boolean": F.lower("v").isin(*profiling.BOOLEAN_WORDS), "integer": profiling.is_integer_text(F.col("v")), "decimal": profiling.is_decimal_text(F.col("v")), "date": profiling.is_date_text(F.col("v"))}
    for r in values.select("v", profiling.type_mask(F.col("v")).alias("mask"), *(t.alias(k) for k, t in tests.items())).collect():
        assert {k for k, b in profiling.MASK.items() if r["mask"] & b} == {k for k in tests if r[k]}, r


@pytest.mark.parametrize("key", ["text", "timestamp", "decimal"])
def test_places_of_secrets_need_no_row_per_character(spark, key, monkeypatch):
    monkeypatch.setattr(redaction, "TEXT_BYTES", 50)
    kind = {"text": "string", "timestamp": "timestamp", "decimal": "decimal(20,2)"}[key]
    texts = [(k, f"\U0001f600{'é' * k}pass-{k % 3} and word{k} pass") for k in range(40)] + [(50, None), (51, "")]
    df = spark.createDataFrame(texts, "n int, text string").selectExpr(f"cast({'timestamp_seconds(n)' if key == 'timestamp' else 'n'} as {kind}) as id", "text", "n").repartition(3)
    secrets = ["pass-1", "pass-2 and", "é" * 30, "d7", "w"]
    table = spark.createDataFrame([(s,) for s in secrets], "secret string")
    found = redaction.spans(df, "id", "text", table)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and found.schema["id"].dataType == df.schema["id"].dataType
    got = {r["n"]: r["text"] for r in redaction.redact(df, "id", "text", table).collect()}
    assert got == {k: None if t is None else redacted(t, secrets) for k, t in texts}
