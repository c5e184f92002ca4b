"""CSV records with line breaks, from files cut into splits of a few bytes."""

from __future__ import annotations

import random
from contextlib import contextmanager

import pytest

from martloom.sources import quoted, raw_csv

COLUMNS = ["id", "label", "note"]


@contextmanager
def splits_of(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    for name, value in zip(names, (size, 1, 1)):
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name in names:
            spark.conf.unset(name)


def _cell(rng):
    text = "".join(rng.choice(["a", "bc", " ", ",", "\n", "\r\n", '"', "é", "\n\n"]) for _ in range(rng.choice([0, 1, 4, 40])))
    return text if text.isalnum() else '"' + text.replace('"', '""') + '"'


def _files(folder, seed, end="\n"):
    rng = random.Random(seed)
    folder.mkdir()
    for k in range(3):
        lines = [f'{k}-{i},{_cell(rng)},{_cell(rng)}' + (",more" if i % 9 == 5 else "") for i in range(25)]
        (folder / f"{k}.csv").write_bytes(("id,label,note" + end + end.join(lines) + end).encode())
    return str(folder)


@pytest.mark.parametrize("size", [24, 300])
@pytest.mark.parametrize("most", [0, 100])
def test_records_do_not_depend_on_splits(spark, tmp_path, size, most):
    path = _files(tmp_path / "f", 7)
    with splits_of(spark, size):
        tasks = spark.read.text(path).rdd.getNumPartitions()
        got = sorted(r["record"] for r in quoted.records(spark, path, most).filter("not first").collect())
    assert tasks > 40 if size == 24 else tasks > 3
    want = []
    for k in range(3):
        text, record, odd = (tmp_path / "f" / f"{k}.csv").read_bytes().decode(), "", False
        for part in text.split("\n")[1:-1]:
            record = f"{record}\n{part}" if odd else part
            odd ^= part.count('"') % 2 == 1
            want += [] if odd else [record]
    assert got == sorted(want)


@pytest.mark.parametrize("size", [64])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_are_those_of_whole_files(spark, tmp_path, size, end):
    path = _files(tmp_path / "f", 3, end)
    # Spark turns the breaks inside cells into the one that ends lines, then into a line feed; here they stay.
    plain = lambda row: tuple(c if c is None or end == "\n" else c.replace("\r\n", "\n") for c in row)
    whole = sorted(map(plain, raw_csv.read_raw_csv(spark, path, COLUMNS, multi_line=True).collect()), key=str)
    with splits_of(spark, size):
        rows = quoted.read_quoted_csv(spark, path, COLUMNS).collect()
        got = sorted(map(plain, rows), key=str)
        wide = quoted.diverted_records(spark, path, COLUMNS).collect()
    assert got == whole and len(got) == 66
    assert any("\r\n" in (r["note"] or "") for r in rows)
    assert len(wide) == 9 and all(r["record"].endswith(",more") for r in wide)


def test_open_cells_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,label,note\n1,x,"never\nclosed\n')
    (tmp_path / "b.csv").write_text('id,label,note\n2,"y",z\n\n')
    (tmp_path / "c.csv").write_text("")
    with splits_of(spark, 8):
        got = sorted(r["record"] for r in quoted.records(spark, str(tmp_path)).collect())
    assert got == ['1,x,"never\nclosed', '2,"y",z', "id,label,note", "id,label,note"]
    (tmp_path / "d.csv").write_text("label,id,note\n")
    with pytest.raises(raw_csv.HeaderError):
        quoted.read_quoted_csv(spark, str(tmp_path), COLUMNS)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("")
    assert quoted.read_quoted_csv(spark, str(tmp_path / "none"), COLUMNS).collect() == []


def test_a_quoted_header_may_span_lines_and_change_the_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"note","two\nlines",id\n1,2,3\n')
    with splits_of(spark, 8):
        rows = quoted.read_quoted_csv(spark, str(tmp_path), ["id", "two\nlines", "note"]).collect()
    assert [tuple(r) for r in rows] == [("3", "2", "1")]
