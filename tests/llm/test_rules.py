"""Robust estimates with many bad documents."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from martloom.llm import rules


@pytest.mark.parametrize("bad", [0.34, 0.4])
@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_estimates_ignore_a_third_of_copies(spark, bad, spread):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, rules.P)) * 0.3
    n = int(bad * len(x))
    x[:n] = 4 + spread * rng.normal(size=(n, rules.P))
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], ["__group", *rules.X])
    far = rows.join(rules.fit(rows), "__group").withColumn("d", rules._distance() / F.col("scale"))
    assert far.filter("d > 80").count() == far.filter("d > 80 and x0 + x1 + x2 > 4").count() >= 0.99 * n


def _least_logdet(x: np.ndarray, rng: np.random.Generator, tries: int = 60) -> float:
    """Concentration steps in plain numpy from many random small subsets."""
    floor, best = np.diag(np.square(list(rules.STATISTICS.values()))), np.inf
    for _ in range(tries):
        near = x[rng.choice(len(x), 2 * rules.P, replace=False)]
        for _ in range(30):
            d = x - near.mean(0)
            d = np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(near.T, bias=True) + floor), d)
            near = x[d <= np.sort(d)[(len(x) + 1) // 2 - 1]]
        best = min(best, np.linalg.slogdet(np.cov(near.T, bias=True) + floor)[1])
    return best


@pytest.mark.parametrize("bad", [0.0, 0.2, 0.4])
def test_determinants_are_as_small_as_those_of_random_starts(spark, bad):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(rules.P, rules.P)) * 0.5
    x = rng.normal(size=(800, rules.P)) @ mix
    n = int(bad * len(x))
    x[:n] += 6 * mix[0]
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], ["__group", *rules.X])
    assert rules.fit(rows).first()["raw_logdet"] <= _least_logdet(x, rng) + 0.1


def test_small_sources_are_judged_by_the_whole_language(spark):
    rng = np.random.default_rng(6)

    def prose():
        return " ".join("abcdefghijklm"[: rng.integers(2, 12)] + str(rng.integers(500)) for _ in range(rng.integers(60, 200))) + "."

    rows = [(k, prose(), "en", "hot") for k in range(300)] + [(1000 + k, prose(), "en", f"s{k % 3}") for k in range(12)]
    rows += [(2000, "# * $ % & | " * 2 + " ".join(f"#{k}$" for k in range(300)), "en", "s1"), (3000, prose(), "xx", "rare"), (4000, "", "en", "none")]
    got = {r["doc_id"]: r for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    assert len(got) == len(rows) and all((r["distance"] is None) == (d == 4000) for d, r in got.items())
    assert not got[2000]["kept"] and not got[2000]["base_failed"]
    assert got[3000]["kept"] and all(got[1000 + k]["kept"] for k in range(12))
