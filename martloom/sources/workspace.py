"""Workspace log tables shaped from the plain tables: datasets, runs, charts, insights, cards,
provider attempts and sessions. Each is a projection, so it grows with the table behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martloom.sources.feeds import table

# Each entry is (table, select list). The lists use only syntax any SQL engine reads.
LOG_TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "datasets": ("customer", (
        "c_custkey as dataset_id", "c_custkey % 25 as session_id", "c_name as dataset_name",
        "case c_mktsegment when 'BUILDING' then 'demo_raw_retail' else 'upload' end as source_type",
        """case c_mktsegment when 'BUILDING' then 'ready_for_analysis' when 'HOUSEHOLD' then 'ready_for_analysis'
        when 'MACHINERY' then 'transforming' when 'AUTOMOBILE' then 'schema_review' else 'deleted' end as status""",
        "case when c_acctbal < 0 then '2024-02-01' end as deleted_at",
        "c_acctbal > 5000 as has_columns", "c_acctbal > 8000 as has_questions",
    )),
    "runs": ("orders", (
        "o_orderkey as run_id",
        "case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then null else o_custkey end as dataset_id",
        "o_custkey % 25 as session_id",
        """case o_orderpriority when '1-URGENT' then '  Show   revenue by month' when '2-HIGH' then 'show revenue by month?'
        when '3-MEDIUM' then 'Top products by margin' when '4-NOT SPECIFIED' then 'TOP products  by margin!? '
        else 'Which stores sold most ?' end as question""",
        "case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status",
        """case o_orderpriority when '1-URGENT' then 'mart_sales_performance' when '2-HIGH' then 'mart_sales_performance'
        when '5-LOW' then 'mart_store_performance' else 'mart_product_performance' end as source_model""",
        "cast(floor(o_totalprice) as bigint) as row_count",
        "o_orderdate as created_at",
        "case when o_orderstatus = 'F' then o_orderdate end as completed_at",
    )),
    "charts": ("lineitem", (
        "l_orderkey as run_id",
        "concat('chart-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as chart_id",
        "case l_returnflag when 'A' then 'bar' when 'N' then 'line' else 'table' end as chart_type",
        "cast(l_linenumber as bigint) as sort_order",
    )),
    "insights": ("lineitem", (
        "l_orderkey as run_id",
        "concat('insight-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as insight_id",
        "case when l_linenumber = 1 then 'question' else 'chart' end as insight_level",
        "case when l_linestatus = 'O' and l_discount > 0.05 then 'completed' when l_linestatus = 'F' then 'failed' else 'pending' end as status",
        "cast(l_linenumber as bigint) as sort_order",
    )),
    "cards": ("orders", (
        "o_orderkey as card_id", "o_orderkey as run_id", "o_custkey % 25 as session_id", "o_custkey as dataset_id",
        """case o_orderpriority when '1-URGENT' then 'active' when '2-HIGH' then 'archived'
        else 'removed' end as status""",
        "cast(floor(o_totalprice / 1000) as bigint) as sort_order", "o_orderdate as created_at",
    )),
    "attempts": ("events", (
        "event_id as attempt_id", "user_id as dataset_id", "ts as created_at",
        """case event_type when 'view' then 'semantic_preparation' when 'click' then 'semantic_preparation'
        when 'signup' then 'dataset_question_suggestions' when 'error' then 'analysis_plan'
        else 'insight_generation' end as task_type""",
        """case when value < 20 then 'background_job' when value < 50 then 'primary_model'
        when value < 100 then 'secondary_model' else 'fallback_model' end as lane""",
        """case when value < 10 then 'running' when value < 40 then 'failed' when value < 60 then 'unavailable'
        else 'completed' end as status""",
        "value >= 15 as has_summary",
    )),
    "sessions": ("nation", (
        "cast(n_nationkey as bigint) as session_id",
        "case when n_regionkey = 1 then timestamp '1998-01-01 00:00:00' end as reset_at",
    )),
}


def log_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = LOG_TABLES[name]
    return table(spark, sf_dir, source).selectExpr(*columns)
