"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from check import compare, duck

from __spark_entry__ import entry
from martloom.registry import load

SQL = load().sql


def queries():
    return load().queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(queries()) == set(SQL)


def test_entry_has_rows(spark):
    result = entry(spark)
    assert result.columns == ["order_month", "revenue"]
    assert result.count() > 0


# Operators that pair all rows, or leave the JVM row by row: no query may plan one.
UNWANTED = ("RoundRobin", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "ExistingRDD")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in UNWANTED if op in plan]
    assert compare(spark, con, name, lambda *_: df, SQL[name], sf_dir) is None


def scans(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_a_product_dimension_reads_two_tables_and_four_columns(spark, sf_dir):
    read = scans(queries()["dim_product"](spark, sf_dir))
    assert len(read) == 2
    assert any("ReadSchema: struct<l_partkey:bigint>" in line for line in read)
    assert any("ReadSchema: struct<p_partkey:bigint,p_name:string,p_type:string>" in line for line in read)


def test_a_date_dimension_never_joins_customers(spark, sf_dir):
    assert not [line for line in scans(queries()["dim_date"](spark, sf_dir)) if "customer" in line]


def test_a_plan_filter_reaches_the_scan(spark, sf_dir):
    read = scans(queries()["plan_filter_eq"](spark, sf_dir))
    assert any("p_type" in line and "PROMO" in line for line in read)


def test_profile_aggregates_the_cells_once(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries()["profile_columns"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange [raw_column_name" in plan


def test_history_ranks_runs_before_it_counts_their_children(spark, sf_dir):
    plan = queries()["workspace_history"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    ranked = plan.index("Window ")
    # Plans print from the top: the joins that describe runs stand above the ranking.
    assert "LeftSemi" in plan and plan.index("LeftOuter") < ranked


def test_entry_offers_the_library_queries():
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as offered

    assert set(queries()) <= set(offered()) and set(SQL) <= set(oracle_sql())
