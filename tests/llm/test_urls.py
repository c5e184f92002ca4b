"""What the url model learns from its labelled table."""

from __future__ import annotations

from pyspark.sql import functions as F

from martloom.llm import urls


def test_held_out_hosts(spark):
    table = urls.parted(urls.labelled_urls(spark)).persist()
    assert 3000 < table.count() < 4000 and table.select("__host").distinct().count() == table.count()
    shares = {r["__label"]: r["count"] for r in table.groupBy("__label").count().collect()}
    assert shares[0] > 3 * shares[1]
    held = F.pmod(F.xxhash64(F.lit("fold"), "__host"), F.lit(4)) == 0
    model = urls.train(table.filter(~held))
    found = model.scored(table.filter(held)).select("__label", (F.col("__score") >= 0.5).cast("int").alias("p")).collect()
    right = {v: [r["p"] == v for r in found if r["__label"] == v] for v in (0, 1)}
    assert sum(right[1]) / len(right[1]) > 0.9 and sum(right[0]) / len(right[0]) > 0.98 and len(found) > 400


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = urls.judged(pages).filter("rule is null").select("host", "verdict").distinct().collect()
    blocked = {r["host"] for r in got if r["verdict"] == "block"}
    assert blocked == {r["host"] for r in got if "adult" in r["host"]} and len(got) > 20
