"""What lies on disk while a query runs: shuffles of lines, shuffles that have done their work."""

from __future__ import annotations

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

# Keys that are missing, that no table has, or that a table has twice.
TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "ASIA"), (1, "EUROPE")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "CHINA", 0), (1, "FRANCE", 1), (2, "NOWHERE", None)]),
    "customer": (
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        [(k, f"Customer#{k}", k % 3, 1.0, ("BUILDING", "MACHINERY", None)[k % 3]) for k in (1, 2, 3, 3)],
    ),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(k, f"Supplier#{k}", k % 4, 1.0) for k in (1, 2, 2, 3)]),
    "part": (
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        [(k, f"part {k % 2}", "b", ("PROMO", "LARGE")[k % 2], 1, 900.125 + k) for k in (1, 2, 3, 3)],
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        [(k, c, "O", 1.0, datetime(1995, 1 + k % 3, 7), "1-URGENT") for k, c in ((43, 9), (44, 3), (44, 3), (46, None), (47, 7), (48, 1), (49, 2), (82, 3))],
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp",
        [
            (o, p, s, n, float(n), 10.555 * n, 0.05 * n, 0.0, "RAN"[n % 3], "OF"[n % 2], datetime(1995, 3, 1))
            for n, (o, p, s) in enumerate([(43, 1, 1), (44, 2, 2), (44, 3, 2), (46, 3, 3), (47, None, 9), (48, 5, None), (49, 1, 1), (50, 2, 3), (None, 1, 1), (82, 3, 2), (82, 1, 1)])
        ],
    ),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture()
def large(spark):
    """No table counts as small enough to be broadcast by its size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}


def left_after(spark, before):
    """Shuffle files that are not gone after some seconds."""
    until = time.time() + 10
    while (left := shuffled_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def test_lines_are_shuffled_for_parts_and_orders_only(spark, tables, large):
    from martloom.sources.feeds import invoice_feed, retail_feed

    for feed in (retail_feed, invoice_feed):
        plan = planned(feed(spark, tables))
        assert sorted(k for k in ("l_orderkey", "l_partkey", "l_suppkey") for _ in range(plan.count(f"hashpartitioning({k}#"))) == ["l_orderkey", "l_partkey"]
        # Orders meet their customers before they meet the lines.
        assert plan.index("o_orderkey#") < plan.index("hashpartitioning(o_custkey#") and "l_" not in plan[plan.index("hashpartitioning(o_custkey#"):plan.index("customer.parquet")]


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_feeds_keep_lines_without_or_with_several_matches(spark, tables, large, monkeypatch, most):
    """Rows as single joins in the order of the line's tables give them."""
    from martloom.sources import feeds

    attach = feeds._attach
    monkeypatch.setattr(feeds, "_attach", lambda s, d, needed: attach(s, d, needed, most))
    t = {name: feeds.table(spark, tables, name) for name in TABLES}
    plain = t["lineitem"]
    for name, on in (
        ("orders", "l_orderkey = o_orderkey"), ("customer", "o_custkey = c_custkey"), ("part", "l_partkey = p_partkey"),
        ("supplier", "l_suppkey = s_suppkey"), ("nation", "s_nationkey = n_nationkey"), ("region", "n_regionkey = r_regionkey"),
    ):
        plain = plain.join(t[name], F.expr(on), "left")
    want = plain.selectExpr(
        "concat('LINE-', l_orderkey, '-', l_linenumber)", "concat('CUST-', o_custkey)", "c_name", "p_name", "s_name", "r_name",
        "cast(cast(p_retailprice as decimal(18,2)) as string)", "cast(cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(18,2)) as decimal(18,2)) as string)",
    )
    got = feeds.retail_feed(spark, tables).select(
        "order_line_id", "customer_id", "customer_name", "product_name", "store_name", "store_region", "unit_price", "discount_amount"
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.toDF(*got.columns).collect()))


def test_a_copy_leaves_no_shuffle_behind(spark):
    from martloom.plans import batch

    before = shuffled_files(spark)
    copy = batch.kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not left_after(spark, before)
    assert sorted(map(tuple, copy.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_a_batch_joins_its_lines_before_its_plans(spark, tables, large):
    """The marts are read from copies, so shuffles of lines do not lie beside each other until the last plan is answered."""
    from martloom.registry import analysis
    from martloom.registry.retail import mart, marts

    found = analysis.REG.queries["plan_batch"](spark, tables)
    assert "l_orderkey" not in planned(found) and "lineitem" not in planned(found)
    for name, copy in marts(spark, tables).items():
        assert sorted(map(str, copy.collect())) == sorted(map(str, mart(spark, tables, name).collect())), name


def test_a_profile_moves_lines_twice_before_its_cells(spark, tables, large):
    from martloom.operators.profiling import NULL_WORDS
    from martloom.registry import profiling
    from martloom.sources.feeds import retail_feed

    profile = profiling.REG.queries["profile_columns"](spark, tables)
    plan = planned(profile)
    assert {k for k in ("l_orderkey", "l_partkey", "l_suppkey") if f"hashpartitioning({k}#" in plan} == {"l_orderkey", "l_partkey"}
    cells = [r.asDict() for r in retail_feed(spark, tables).collect()]
    found = {r.raw_column_name: (r.null_count, r.unique_count) for r in profile.collect()}
    assert len(cells) > len(TABLES["lineitem"][1])
    for name in cells[0]:
        values = [(c[name], c["order_line_id"]) for c in cells if c[name] is not None and c[name] not in NULL_WORDS]
        # A value counts as distinct where it has a place: the line without an order has none.
        assert found[name] == (len(cells) - len(values), len({v for v, line in values if line})), name


def test_a_layer_begins_when_the_shuffles_before_it_are_gone(spark, tables, large, tmp_path):
    from martloom.plans.retail import RetailModel
    from martloom.sources import sinks
    from martloom.sources.feeds import retail_feed

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    lazy, model = (RetailModel(retail_feed(spark, tables)) for _ in range(2))
    setting, before, left = spark.conf.get(key, "false"), shuffled_files(spark), {}
    save = sinks.parquet_writer(str(tmp_path), {"fact_sales": "order_month"})

    def writer(name, df):
        left[name] = left_after(spark, before)
        return save(name, df)

    written = model.write(writer)
    assert list(left) == [n for names in RetailModel.LAYERS.values() for n in names] and not any(left.values())
    assert not left_after(spark, before) and spark.conf.get(key, "false") == setting
    for name, df in written.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, lazy.model(name).select(*df.columns).collect())), name
