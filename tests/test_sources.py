"""CSV loads, file checks and sinks."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from martloom.sources import files, raw_csv, sinks

GOOD = b"order_id,revenue\n1,2.5\n2,\n"
CASES = {
    "good.csv": (GOOD, []),
    "quoted.csv": (b'id,"full, name"\n1,"a\nb"\n2,"x ""y"" z"\n', []),
    "bom.csv": (b"\xef\xbb\xbfid,name\n1,a\n", []),
    "data.txt": (GOOD, ["wrong_extension"]),
    "empty.csv": (b"", ["empty_file"]),
    "nul.csv": (b"a,b\n1,\x00\n", ["binary_content"]),
    "latin.csv": ("a,b\n1,é\n".encode("latin-1"), ["not_utf8"]),
    "open_quote.csv": (b'a,b\n1,"x\n', ["unreadable_csv"]),
    "after_quote.csv": (b'a,b\n1,"x"y\n', ["unreadable_csv"]),
    "blank_first_line.csv": (b"\na,b\n", ["no_header"]),
    "one_column.csv": (b"a\n1\n", ["too_few_columns"]),
    "blank_header.csv": (b"a, ,c\n1,2,3\n", ["blank_header", "unsafe_header"]),
    "same_header.csv": (b"Order ID,order-id\n1,2\n", ["duplicate_header"]),
    "no_rows.csv": (b"a,b\n , \n\n", ["no_data_rows"]),
    "ragged.csv": (b"a,b\n1,2\n3\n", ["width_mismatch"]),
    "late_ragged.csv": (b"a,b\n" + b"1,2\n" * 25 + b"3\n", ["width_mismatch"]),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("uploads")
    for name, (content, _) in CASES.items():
        (path / name).write_bytes(content)
    (path / "large.csv").write_bytes(b"a,b\n" + b"1,2\n" * 300_000)
    return str(path)


def test_conformance_of_files_on_disk(spark, folder):
    found: dict[str, list[str]] = {}
    log = spark.createDataFrame([(n,) for n in CASES], "file_name string")
    for r in files.conformance(files.read_files(spark, folder, log), 1).collect():
        found.setdefault(r["file_name"], []).append(r["rule"])
    expected = {n: rules for n, (_, rules) in CASES.items() if rules} | {"large.csv": ["file_too_large"]}
    assert {n: sorted(r) for n, r in found.items()} == {n: sorted(r) for n, r in expected.items()}


def test_the_first_row_of_another_width_is_named(spark, folder):
    rows = files.conformance(files.read_files(spark, folder), 5).filter("rule = 'width_mismatch'").collect()
    assert {r["file_name"]: r["bad_row"] for r in rows} == {"ragged.csv": 2, "late_ragged.csv": 26}


def test_manifest(spark, folder):
    rows = {r["file_name"]: r for r in files.manifest(files.read_files(spark, folder)).collect()}
    good = rows["good.csv"]
    assert good["checksum_sha256"] == hashlib.sha256(GOOD).hexdigest()
    assert (good["size_bytes"], good["row_count"], good["column_count"], good["extension"]) == (len(GOOD), 2, 2, ".csv")
    assert (rows["quoted.csv"]["row_count"], rows["quoted.csv"]["column_count"]) == (2, 2)
    assert (rows["large.csv"]["row_count"], rows["large.csv"]["column_count"]) == (300_000, 2)


def test_long_quoted_field_is_handled(spark):
    body = 'a,b\n1,"' + '""x,' * 50_000 + '"\n'
    df = spark.createDataFrame([("f.csv", len(body), bytearray(body.encode()))], "file_name string, size_bytes long, content binary")
    assert files.conformance(df, 5).collect() == []


def test_csv_round_trip_keeps_text(spark, tmp_path):
    rows = [("1", ' a "b", c ', "NULL"), ("2", "two\nlines", "null"), ("3", "", " NULL "), ("4", "x", "Null")]
    source = spark.createDataFrame(rows, "id string, label string, note string")
    raw_csv.write_csv(source, str(tmp_path / "csv"))
    loaded = raw_csv.read_raw_csv(spark, str(tmp_path / "csv"), ["id", "label", "note"], multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in loaded] == [
        ("1", ' a "b", c ', None), ("2", "two\nlines", None), ("3", None, " NULL "), ("4", "x", "Null"),
    ]


def test_rows_of_the_wrong_width_are_kept_aside(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    path = str(tmp_path / "x.csv")
    assert [tuple(r) for r in raw_csv.read_raw_csv(spark, path, ["a", "b"]).collect()] == [("1", "2")]
    bad = raw_csv.diverted_rows(spark, path, ["a", "b"]).collect()
    assert sorted((r["line"], r["n_cells"]) for r in bad) == [("3", 1), ("4,5,6", 3)]


def test_columns_are_found_by_the_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("c,b,a\n1,2,3\n")
    assert [tuple(r) for r in raw_csv.read_raw_csv(spark, str(tmp_path / "x.csv"), ["a", "b", "c"]).collect()] == [("3", "2", "1")]
    with pytest.raises(raw_csv.HeaderError):
        raw_csv.read_raw_csv(spark, str(tmp_path / "x.csv"), ["a", "b", "d"])


def test_zero_rows_fail_and_leave_no_table(spark):
    empty = spark.createDataFrame([], "a string")
    with pytest.raises(raw_csv.EmptyLoadError):
        raw_csv.load_table(empty, "empty_load")
    assert not spark.catalog.tableExists("empty_load")


def test_an_empty_load_keeps_the_table_of_that_name(spark):
    raw_csv.load_table(spark.createDataFrame([("x",)], "a string"), "kept_load")
    with pytest.raises(raw_csv.EmptyLoadError):
        raw_csv.load_table(spark.createDataFrame([], "a string"), "kept_load")
    assert [r["a"] for r in spark.table("kept_load").collect()] == ["x"]
    assert raw_csv.load_table(spark.createDataFrame([("y",)], "a string"), "kept_load").first()["a"] == "y"
    assert not [t.name for t in spark.catalog.listTables() if "__load_" in t.name]
    spark.sql("DROP TABLE kept_load")


def test_load_table(spark):
    assert raw_csv.load_table(spark.createDataFrame([("x",)], "a string"), "small_load").count() == 1
    spark.sql("DROP TABLE small_load")


def test_preview_limits(spark):
    df = spark.range(100).withColumn("x", F.col("id").cast("string"))
    assert [r["X no"] for r in raw_csv.preview(df, [("id", "X no")], ["id"], 3).collect()] == [0, 1, 2]
    assert raw_csv.preview(df, [], ["id"]).columns == []
    for bad in (0, 51):
        with pytest.raises(ValueError):
            raw_csv.preview(df, [("id", "id")], ["id"], bad)


def test_snapshot_counts_its_preview(spark):
    df = spark.range(30).orderBy(F.col("id").desc()).select("id", F.lit("1.50").cast("decimal(9,2)").alias("d"))
    row = sinks.result_snapshot(df, 5).collect()[0]
    assert row["row_count"] == 5
    assert [r["id"] for r in row["preview_rows"]] == [29, 28, 27, 26, 25]
    assert row["preview_rows"][0]["d"] == 1.5
    assert [f["type"] for f in row["output_schema"]] == ["bigint", "decimal(9,2)"]


def test_partitioned_layer_reads_back_with_its_types(spark, tmp_path):
    df = spark.sql("select 1 as a, date'2026-01-01' as m union all select 2, cast(null as date)")
    back = sinks.parquet_writer(str(tmp_path), {"t": "m"})("t", df)
    assert back.schema["m"].dataType == df.schema["m"].dataType
    assert sorted(back.collect(), key=lambda r: r["a"]) == sorted(df.collect(), key=lambda r: r["a"])


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from martloom.session import shared_folder

    def session(master, folder):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="a", getConf=lambda: conf))

    assert shared_folder(session("spark://host:7077", "hdfs:///x")) == "hdfs:///x"
    with pytest.raises(ValueError):
        shared_folder(session("local-cluster[2,1,1024]", None))
    assert shared_folder(session("local[2]", None)) == shared_folder(session("local[2]", None))
