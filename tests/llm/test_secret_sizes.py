"""The bitmap of values' words stays sparse as their number grows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from martloom.llm import secret_scan as S


def test_few_other_words_pass_whatever_the_number_of_pieces(spark):
    pieces = spark.range(300_000).select(F.translate(F.lpad(F.col("id").cast("string"), 8, "0"), "0123456789", "abcdefghij").alias("piece"))
    wanted = S._bitmap(pieces)
    rng = random.Random(3)
    others = {"".join(rng.choices("klmnopqrstuvwxyz", k=9)) for _ in range(5000)}
    found, total = S.counted([" ".join([*others, "aaaaaaab", "aaaccccc"]).encode()], wanted)
    assert {"aaaaaaab", "aaaccccc"} <= found.keys() and total == len(others) + 2
    assert len(found) < 0.05 * len(others)


def test_no_piece_lets_nothing_through(spark):
    wanted = S._bitmap(spark.createDataFrame([], "piece string"))
    assert S.counted([b"word other"], wanted) == ({}, 2)
