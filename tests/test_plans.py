"""Plans in batch, literals of other types, and distinct counts over fewer dimensions."""

from __future__ import annotations

import datetime
import decimal
import json

import pytest
from pyspark.sql import functions as F

from martloom.operators import distinct_counts
from martloom.plans.analysis import AnalysisPlan, Filter, run_plan
from martloom.plans.batch import distinct_plans, run_batch

DAY = datetime.date
MART = [
    (DAY(2024, 1, 1), "a", 1, decimal.Decimal("1.50"), 0.25, 3), (DAY(2024, 1, 1), "b", 2, decimal.Decimal("2.00"), None, 4),
    (DAY(2024, 2, 1), "a", 1, decimal.Decimal("4.00"), 1.5, 5), (DAY(2024, 2, 1), None, None, None, 2.0, None),
    (None, "b", 3, decimal.Decimal("-1.00"), 8.0, 0), (DAY(2024, 3, 1), "5", 10, decimal.Decimal("7.00"), 1.0, 2),
]
CATALOG = {"m": {"grain": "", "dimensions": ["day", "kind", "shelf"], "metrics": ["amount", "rate", "n"]}}
PLAN_TYPE = (
    "plan_id long, source_model string, metrics array<struct<name: string, aggregation: string>>, dimensions array<string>, "
    "filters array<struct<field: string, operator: string, value: string>>, sort array<struct<field: string, direction: string>>, row_limit long"
)


@pytest.fixture(scope="module")
def mart(spark):
    return spark.createDataFrame(MART, "day date, kind string, shelf int, amount decimal(18,2), rate double, n long")


PLANS = [
    (("amount", "sum"), ("n", "count")), (("rate", "avg"),), (("amount", "min"), ("rate", "max"), ("n", "sum")), (("amount", "avg"),), (("n", "max"), ("amount", "count")),
]
FILTERS = [
    (), (("kind", "=", "a"),), (("kind", "!=", "b"), ("day", "!=", "2024-02-01")), (("day", "=", "word"),), (("shelf", "=", 1),), (("shelf", "!=", True),), (("kind", "!=", 5),),
    (("kind", "=", None),), (("shelf", "!=", "1"), ("kind", "=", "b")),
]


def cases():
    for k, filters in enumerate(FILTERS):
        for j, dimensions in enumerate(((), ("day",), ("kind", "shelf"), ("shelf",), ("kind", "day", "shelf"))):
            metrics = PLANS[(k + j) % len(PLANS)]
            sort = ((metrics[0][0], ("asc", "desc")[k % 2]), *((d, ("desc", "asc")[j % 2]) for d in dimensions[:1]))
            yield AnalysisPlan("m", metrics, dimensions, tuple(Filter(*f) for f in filters), sort if k % 3 else (), (None, 2, 500)[(k + j) % 3])


def test_batch_agrees_with_plans_run_alone(spark, mart):
    plans = list(cases())
    rows = [
        (i, p.source_model, list(p.metrics), list(p.dimensions), [(f.field, f.operator, None if f.value is None else json.dumps(f.value)) for f in p.filters], list(p.sort), p.limit)
        for i, p in enumerate(plans)
    ]
    asked = distinct_plans(spark.createDataFrame([*rows, (1000, *rows[1][1:])], PLAN_TYPE))
    found = asked.select("plan_id", "plan_key").join(run_batch(asked, {"m": mart}, CATALOG), "plan_key").collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["plan_id"], {}).setdefault((r["position"], tuple(r["members"])), {})[r["metric"]] = r["value"]
    assert got[1000] == got[1]
    for i, plan in enumerate(plans):
        alone = run_plan(mart, plan)
        texts = [F.col(d).cast("string") for d in plan.dimensions]
        want = [(tuple(r[: len(texts)]), {m: None if v is None else float(v) for (m, _), v in zip(plan.metrics, r[len(texts) :])})
                for r in alone.select(*texts, *(m for m, _ in plan.metrics)).collect()]
        mine = got.get(i, {})
        key = lambda x: str(x)
        assert sorted(((m, v) for m, v in want), key=key) == sorted(((k[1], v) for k, v in mine.items()), key=key), plan
        if plan.limit is not None:
            assert [k[1] for k in sorted(mine, key=lambda k: k[0])] == [m for m, _ in want], plan
        else:
            assert {k[0] for k in mine} <= {None}


def test_batch_of_nothing(spark, mart):
    none = spark.createDataFrame([], PLAN_TYPE)
    assert run_batch(none, {"m": mart}, CATALOG).count() == 0
    one = spark.createDataFrame([(1, "m", [("n", "sum"), ("amount", "count")], [], [], [], None), (2, "m", [("n", "sum")], ["kind"], [], [], None)], PLAN_TYPE)
    got = {(r["metric"], r["value"]) for r in run_batch(one, {"m": mart.limit(0)}, CATALOG).collect()}
    assert got == {("n", None), ("amount", 0.0)}


def test_literals_take_the_fields_type(mart):
    def kept(field, operator, value):
        return run_plan(mart, AnalysisPlan("m", (("n", "count"),), filters=(Filter(field, operator, value),))).first()["n"]

    assert [kept("kind", "=", 5), kept("kind", "!=", 5), kept("kind", "!=", True), kept("kind", "=", None), kept("kind", "!=", None)] == [1, 4, 5, 0, 0]
    assert [kept("day", "!=", "x"), kept("day", "!=", 5), kept("day", "=", "2024-01-01"), kept("day", "=", True)] == [0, 0, 2, 0]
    assert [kept("shelf", "=", "1"), kept("shelf", "=", "one"), kept("shelf", "!=", 1), kept("amount", "=", "1.5")] == [2, 0, 3, 1]


def test_distinct_counts_of_coarser_groups(spark):
    rows = [(f"o{i % 90_000:06d}", ("x", "y", None)[i % 3], i % 7) for i in range(120_000)] + [(None, "x", 1), (None, "z", 0)]
    facts = spark.createDataFrame(rows, "order_id string, area string, shop long").repartition(5)
    numbers = distinct_counts.dictionary(facts, "order_id", near="shop")
    assert numbers.count() == numbers.select("number").distinct().count() == 90_000
    found = distinct_counts.members(facts, ["area", "shop"], "order_id", numbers)
    for by in (["area", "shop"], ["area"], ["shop"], []):
        want = facts.filter("order_id is not null").groupBy(*by).agg(F.count_distinct("order_id").alias("members"))
        assert sorted(map(str, distinct_counts.counted(found, by).collect())) == sorted(map(str, want.collect()))
    assert distinct_counts.counted(found.limit(0), []).first()["members"] == 0
    mart = facts.groupBy("area", "shop").agg(F.count_distinct("order_id").alias("orders"), F.count("*").alias("lines"))
    plan = AnalysisPlan("m", (("lines", "sum"), ("orders", "sum")), ("area",), filters=(Filter("shop", "!=", 3),), sort=(("area", "asc"),))
    got = [tuple(r) for r in run_plan(mart, plan, {"orders": found}).collect()]
    sub = facts.filter("shop <> 3").groupBy("area").agg(F.count("*").alias("lines"), F.count_distinct("order_id").alias("orders"))
    # A group without a member still shows its other metrics.
    assert sorted(map(str, got)) == sorted(str((r["area"], r["lines"], r["orders"] or None)) for r in sub.collect())
