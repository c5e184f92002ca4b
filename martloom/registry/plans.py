"""Analysis plans over the retail marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.sql import DataFrame, SparkSession

from martloom.functions.cleaning import safe_ratio
from martloom.operators import distinct_counts
from martloom.plans import retail as R
from martloom.plans.analysis import AnalysisPlan, Filter, run_plan
from martloom.registry.common import Registry
from martloom.registry.retail import MART_SQL, dimension, enriched, mart

REG = Registry()


def plan_query(name: str, plan: AnalysisPlan, select: str) -> None:
    REG.add(
        name,
        lambda s, d: run_plan(mart(s, d, plan.source_model), plan),
        f"with {MART_SQL} {select}",
    )


MONTH = "strftime(order_month, '%Y-%m-%d') as order_month"
plan_query(
    "plan_revenue_trend",
    AnalysisPlan(
        "mart_sales_performance", (("revenue", "sum"),), ("order_month",), sort=(("order_month", "asc"),)
    ),
    f"""select {MONTH}, cast(sum(revenue) as double) as revenue from mart_sales_performance
    group by mart_sales_performance.order_month
    order by mart_sales_performance.order_month asc nulls last""",
)
plan_query(
    "plan_sum",
    AnalysisPlan(
        "mart_product_performance", (("revenue", "sum"), ("quantity", "sum")), ("product_category",)
    ),
    """select product_category, cast(sum(revenue) as double) as revenue,
    cast(sum(quantity) as double) as quantity from mart_product_performance group by 1""",
)
plan_query(
    "plan_avg",
    AnalysisPlan("mart_customer_segments", (("orders", "avg"),), ("customer_segment",)),
    "select customer_segment, avg(orders) as orders from mart_customer_segments group by 1",
)
plan_query(
    "plan_count",
    AnalysisPlan("mart_store_performance", (("revenue", "count"),), ("store_region",)),
    "select store_region, count(revenue) as revenue from mart_store_performance group by 1",
)
plan_query(
    "plan_min_max",
    AnalysisPlan(
        "mart_product_performance", (("quantity", "min"), ("revenue", "max")), ("product_category",)
    ),
    """select product_category, cast(min(quantity) as double) as quantity,
    cast(max(revenue) as double) as revenue from mart_product_performance group by 1""",
)
plan_query(
    "plan_group_two_dims",
    AnalysisPlan(
        "mart_store_performance", (("orders", "sum"), ("revenue", "sum")), ("store_region", "store_name"),
        sort=(("store_region", "asc"), ("store_name", "asc")),
    ),
    """select store_region, store_name, cast(sum(orders) as bigint) as orders,
    cast(sum(revenue) as double) as revenue from mart_store_performance group by 1, 2
    order by store_region asc nulls last, store_name asc nulls last""",
)
plan_query(
    "plan_global_kpi",
    AnalysisPlan("mart_sales_performance", (("revenue", "sum"), ("orders", "sum"))),
    """select cast(sum(revenue) as double) as revenue, cast(sum(orders) as bigint) as orders
    from mart_sales_performance""",
)
plan_query(
    "plan_filter_eq",
    AnalysisPlan(
        "mart_product_performance", (("revenue", "sum"),), ("product_name",),
        filters=(Filter("product_category", "=", "PROMO"),), sort=(("product_name", "asc"),),
    ),
    """select product_name, cast(sum(revenue) as double) as revenue from mart_product_performance
    where product_category = 'PROMO' group by 1 order by product_name asc nulls last""",
)
plan_query(
    "plan_filter_ne",
    AnalysisPlan(
        "mart_product_performance", (("quantity", "sum"),), ("product_category",),
        filters=(Filter("product_category", "!=", "PROMO"), Filter("product_name", "!=", "red widget")),
    ),
    """select product_category, cast(sum(quantity) as double) as quantity from mart_product_performance
    where product_category <> 'PROMO' and product_name <> 'red widget' group by 1""",
)
NULL_PLAN = AnalysisPlan(
    "mart_customer_segments", (("revenue", "sum"), ("orders", "count")), ("customer_segment",),
    filters=(Filter("customer_segment", "!=", "MACHINERY"),),
)
REG.add(
    "plan_filter_null",
    # One segment has no name; a filter on the column keeps no such row, for != neither.
    lambda s, d: run_plan(
        mart(s, d, NULL_PLAN.source_model).withColumn("customer_segment", F.nullif("customer_segment", F.lit("BUILDING"))), NULL_PLAN
    ),
    f"""with {MART_SQL}, m as (select nullif(customer_segment, 'BUILDING') as customer_segment, revenue, orders from mart_customer_segments)
    select customer_segment, cast(sum(revenue) as double) as revenue, count(orders) as orders from m
    where customer_segment <> 'MACHINERY' group by 1""",
)
plan_query(
    "plan_sorted",
    AnalysisPlan(
        "mart_sales_performance", (("gross_margin", "sum"), ("orders", "sum")), ("order_month",),
        sort=(("gross_margin", "desc"), ("order_month", "asc")), limit=500,
    ),
    f"""select {MONTH}, cast(sum(gross_margin) as double) as gross_margin,
    cast(sum(orders) as bigint) as orders from mart_sales_performance
    group by mart_sales_performance.order_month
    order by sum(gross_margin) desc nulls first, mart_sales_performance.order_month asc nulls last limit 500""",
)
plan_query(
    "plan_topk",
    AnalysisPlan(
        "mart_product_performance", (("revenue", "sum"),), ("product_category", "product_name"),
        sort=(("revenue", "desc"), ("product_category", "asc"), ("product_name", "asc")), limit=10,
    ),
    """select product_category, product_name, cast(sum(revenue) as double) as revenue
    from mart_product_performance group by 1, 2
    order by sum(revenue) desc nulls first, product_category asc nulls last, product_name asc nulls last
    limit 10""",
)

# ---- literals of other types than the field ------------------------------------------------------

SEGMENT, MONTHLY = ("mart_customer_segments", "customer_segment"), ("mart_sales_performance", "order_month")
TYPED = {
    # What is compared, and the condition as DuckDB has it.
    "text against number": (*SEGMENT, "!=", 5, "customer_segment <> '5'"),
    "text against boolean": (*SEGMENT, "!=", True, "customer_segment <> 'true'"),
    "text against null": (*SEGMENT, "=", None, "customer_segment = null"),
    "text not null": (*SEGMENT, "!=", None, "customer_segment <> null"),
    "date as text": (*MONTHLY, "=", "1995-03-01", "order_month = date '1995-03-01'"),
    "date against word": (*MONTHLY, "!=", "x", "order_month <> try_cast('x' as date)"),
    "date against number": (*MONTHLY, "!=", 12.5, "order_month <> try_cast('12.5' as date)"),
}


def typed_filters(spark: SparkSession, sf: str) -> DataFrame:
    """One plan per kind of literal. A literal takes the field's type; one that cannot is NULL and keeps nothing."""
    out = None
    for label, (model, field, operator, value, _) in TYPED.items():
        plan = AnalysisPlan(model, (("revenue", "sum"),), (field,), filters=(Filter(field, operator, value),))
        found = run_plan(mart(spark, sf, model), plan).select(F.lit(label).alias("kind"), F.col(field).cast("string").alias("member"), "revenue")
        out = found if out is None else out.unionByName(found)
    return out


REG.add(
    "plan_filter_typed",
    typed_filters,
    f"with {MART_SQL} " + " union all ".join(
        f"select '{label}' as kind, cast({field} as varchar) as member, cast(sum(revenue) as double) as revenue from {model} where {where} group by {field}"
        for label, (model, field, _, _, where) in TYPED.items()
    ),
)

# ---- true distinct counts over fewer dimensions --------------------------------------------------


def order_members(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The bitmaps beside a mart, from one dictionary of orders numbered by date."""
    facts = enriched(spark, sf, "order_id", "customer_id", "store_id")
    numbers = distinct_counts.dictionary(enriched(spark, sf, "order_id"), "order_id", near="order_date")
    by = R.ORDER_MARTS[name]
    return R.order_members(facts, name, dimension(spark, sf, by) if by else None, numbers)


def true_counts(name: str, plan: AnalysisPlan, select: str) -> None:
    REG.add(
        name,
        lambda s, d: run_plan(mart(s, d, plan.source_model), plan, {"orders": order_members(s, d, plan.source_model)}),
        f"with {MART_SQL} {select}",
    )


true_counts(
    "plan_true_orders",
    AnalysisPlan("mart_store_performance", (("orders", "sum"), ("revenue", "sum")), ("store_region",)),
    """select s.store_region, count(distinct order_id) as orders, cast(sum(f.net_revenue) as double) as revenue
    from int f left join dim_store s on f.store_id = s.store_id group by 1""",
)
true_counts(
    "plan_true_orders_total",
    AnalysisPlan("mart_sales_performance", (("revenue", "max"), ("orders", "sum"))),
    "select (select cast(max(revenue) as double) from mart_sales_performance) as revenue, count(distinct order_id) as orders from int",
)
true_counts(
    "plan_true_orders_filtered",
    AnalysisPlan(
        "mart_store_performance", (("orders", "sum"),), filters=(Filter("store_region", "!=", "ASIA"), Filter("store_name", "!=", "Supplier#000000001")),
    ),
    """select count(distinct order_id) as orders from int f join dim_store s on f.store_id = s.store_id
    where s.store_region <> 'ASIA' and s.store_name <> 'Supplier#000000001'""",
)


@REG.query(
    "region_order_value",
    f"""with {MART_SQL} select s.store_region, count(distinct order_id) as orders,
      cast(sum(f.net_revenue) as double) / count(distinct order_id) as average_order_value
    from int f left join dim_store s on f.store_id = s.store_id group by 1""",
)
def region_order_value(spark: SparkSession, sf: str) -> DataFrame:
    """A ratio over a coarser group than the mart's own, from its sums and its members."""
    plan = AnalysisPlan("mart_store_performance", (("orders", "sum"), ("revenue", "sum")), ("store_region",))
    found = run_plan(mart(spark, sf, plan.source_model), plan, {"orders": order_members(spark, sf, plan.source_model)})
    return found.select("store_region", "orders", safe_ratio(F.col("revenue"), F.col("orders")).alias("average_order_value"))


@REG.query(
    "order_members",
    f"""with {MART_SQL}, m as (select s.store_region, s.store_name, f.order_id from int f left join dim_store s on f.store_id = s.store_id)
    select store_region, store_name, count(distinct order_id) as members from m group by 1, 2""",
)
def stored_members(spark: SparkSession, sf: str) -> DataFrame:
    """The members of the store mart's own groups, counted from their bitmaps."""
    return distinct_counts.counted(order_members(spark, sf, "mart_store_performance"), ["store_region", "store_name"])
