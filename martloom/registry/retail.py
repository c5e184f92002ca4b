"""Retail feed: cleaning, layers and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.functions import cleaning as C
from martloom.plans import retail as R
from martloom.registry.common import Registry
from martloom.session import copied
from martloom.sources.feeds import retail_feed, table

REG = Registry()

RAW_SQL = """
raw as (
  select
    'ORD-' || l_orderkey as order_id,
    'LINE-' || l_orderkey || '-' || l_linenumber as order_line_id,
    strftime(o_orderdate, '%Y-%m-%d') as order_date,
    'CUST-' || c_custkey as customer_id, c_name as customer_name, c_mktsegment as customer_segment,
    'PROD-' || p_partkey as product_id, p_name as product_name, p_type as product_category,
    'STORE-' || s_suppkey as store_id, s_name as store_name, r_name as store_region,
    cast(cast(l_quantity as decimal(38,0)) as varchar) as quantity,
    cast(cast(p_retailprice as decimal(18,2)) as varchar) as unit_price,
    cast(cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(18,2)) as decimal(18,2)) as varchar) as discount_amount,
    case when l_returnflag = 'R' then '' else cast(cast(l_extendedprice as decimal(18,2)) as varchar) end as revenue,
    cast(cast(cast(l_extendedprice as decimal(18,2)) * cast(0.60 as decimal(3,2)) as decimal(18,2)) as varchar) as cost,
    case when l_linestatus = 'O' then 'Invoice' else 'Cash' end as payment_method
  from lineitem
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
)"""
STG_SQL = RAW_SQL + """,
stg as (
  select nullif(trim(order_id), '') as order_id, nullif(trim(order_line_id), '') as order_line_id,
    cast(try_strptime(order_date, '%Y-%m-%d') as date) as order_date,
    nullif(trim(customer_id), '') as customer_id, nullif(trim(customer_name), '') as customer_name,
    nullif(trim(customer_segment), '') as customer_segment, nullif(trim(product_id), '') as product_id,
    nullif(trim(product_name), '') as product_name, nullif(trim(product_category), '') as product_category,
    nullif(trim(store_id), '') as store_id, nullif(trim(store_name), '') as store_name,
    nullif(trim(store_region), '') as store_region,
    try_cast(quantity as decimal(18,0)) as quantity, try_cast(unit_price as decimal(18,2)) as unit_price,
    try_cast(discount_amount as decimal(18,2)) as discount_amount, try_cast(revenue as decimal(18,2)) as revenue,
    try_cast(cost as decimal(18,2)) as cost, nullif(trim(payment_method), '') as payment_method
  from raw
)"""
INT_SQL = STG_SQL + """,
int as (
  select *, cast(date_trunc('month', order_date) as date) as order_month,
    coalesce(revenue, quantity * unit_price - coalesce(discount_amount, 0)) as net_revenue,
    coalesce(revenue, quantity * unit_price - coalesce(discount_amount, 0)) - coalesce(cost, 0) as gross_margin
  from stg
)"""
MART_SQL = INT_SQL + """,
dim_customer as (select distinct customer_id, customer_name, customer_segment from int where customer_id is not null),
dim_product as (select distinct product_id, product_name, product_category from int where product_id is not null),
dim_store as (select distinct store_id, store_name, store_region from int where store_id is not null),
dim_date as (
  select distinct order_date, order_month, extract(year from order_date) as order_year,
    extract(month from order_date) as order_month_number
  from int where order_date is not null),
mart_sales_performance as (
  select order_month, count(distinct order_id) as orders, sum(quantity) as quantity,
    sum(net_revenue) as revenue, sum(gross_margin) as gross_margin
  from int group by order_month),
mart_product_performance as (
  select p.product_category, p.product_name, sum(f.quantity) as quantity, sum(f.net_revenue) as revenue,
    sum(f.gross_margin) as gross_margin
  from int f left join dim_product p on f.product_id = p.product_id group by 1, 2),
mart_customer_segments as (
  select c.customer_segment, count(distinct f.order_id) as orders, sum(f.net_revenue) as revenue,
    cast(sum(f.net_revenue) as double) / nullif(count(distinct f.order_id), 0) as average_order_value
  from int f left join dim_customer c on f.customer_id = c.customer_id group by 1),
mart_store_performance as (
  select s.store_region, s.store_name, count(distinct f.order_id) as orders, sum(f.net_revenue) as revenue
  from int f left join dim_store s on f.store_id = s.store_id group by 1, 2)"""

MEASURES = ("quantity", "unit_price", "discount_amount", "revenue", "cost")


def staged(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return R.stage(retail_feed(spark, sf, columns or None))


def enriched(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Enriched rows with the named columns next to the measures and whatever those need."""
    return R.enrich(staged(spark, sf, *dict.fromkeys(("order_date", *columns, *MEASURES))))


def dimension(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return R.dimension(staged(spark, sf, *R.DIMENSIONS[name][1]), name)


# What each mart takes from the lines besides the measures, and its dimension.
MART_INPUTS = {
    "mart_sales_performance": (("order_id",), None),
    "mart_product_performance": (("product_id",), "dim_product"),
    "mart_customer_segments": (("order_id", "customer_id"), "dim_customer"),
    "mart_store_performance": (("order_id", "store_id"), "dim_store"),
}
MART_BUILDERS = {
    "mart_sales_performance": R.sales_mart, "mart_product_performance": R.product_mart,
    "mart_customer_segments": R.segment_mart, "mart_store_performance": R.store_mart,
}


def mart(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A retail mart whose inputs read only the columns and joins it needs."""
    columns, by = MART_INPUTS[name]
    return MART_BUILDERS[name](enriched(spark, sf, *columns), *([dimension(spark, sf, by)] if by else []))


def marts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All retail marts, written down one after the other.

    They take the same joins of the lines, so these are made once, for a copy with the columns of all of them. Every mart's shuffles are gone
    before the next one begins, and a dimension that was written down is broadcast where its size allows it.
    """
    columns = dict.fromkeys(c for names, _ in MART_INPUTS.values() for c in names)
    facts = copied(enriched(spark, sf, *columns).select(*columns, "order_month", "quantity", "net_revenue", "gross_margin"), "facts")
    made = {}
    for name, (_, by) in MART_INPUTS.items():
        made[name] = copied(MART_BUILDERS[name](facts, *([copied(dimension(spark, sf, by), by)] if by else [])), name)
    return made


STG_SELECT = """
select order_id, order_line_id, strftime(order_date, '%Y-%m-%d') as order_date, customer_id, customer_name,
  customer_segment, product_id, product_name, product_category, store_id, store_name, store_region,
  cast(quantity as double) as quantity, cast(unit_price as double) as unit_price,
  cast(discount_amount as double) as discount_amount, cast(revenue as double) as revenue,
  cast(cost as double) as cost, payment_method"""

REG.add("stg_retail_transactions", lambda s, d: staged(s, d), f"with {STG_SQL} {STG_SELECT} from stg")
ENRICHED_SELECT = STG_SELECT + """,
  strftime(order_month, '%Y-%m-%d') as order_month, cast(net_revenue as double) as net_revenue,
  cast(gross_margin as double) as gross_margin"""
REG.add(
    "int_retail_sales_enriched",
    lambda s, d: R.enrich(staged(s, d)),
    f"with {INT_SQL} {ENRICHED_SELECT} from int",
)
REG.add(
    "enrich_sales",
    lambda s, d: R.enrich(staged(s, d)).select(
        "order_id", "product_id", "order_month", "net_revenue", "gross_margin"
    ),
    f"""with {INT_SQL} select order_id, product_id, strftime(order_month, '%Y-%m-%d') as order_month,
    cast(net_revenue as double) as net_revenue, cast(gross_margin as double) as gross_margin from int""",
)
REG.add(
    "fact_sales",
    lambda s, d: R.fact(
        enriched(s, d, "order_line_id", "order_id", "customer_id", "product_id", "store_id", "payment_method")
    ),
    f"""with {INT_SQL} select order_line_id, order_id, strftime(order_date, '%Y-%m-%d') as order_date,
    strftime(order_month, '%Y-%m-%d') as order_month, customer_id, product_id, store_id, payment_method,
    cast(quantity as double) as quantity, cast(unit_price as double) as unit_price,
    cast(discount_amount as double) as discount_amount, cast(net_revenue as double) as net_revenue,
    cast(cost as double) as cost, cast(gross_margin as double) as gross_margin from int""",
)
for _dim, (_key, _columns) in R.DIMENSIONS.items():
    REG.add(
        _dim,
        lambda s, d, name=_dim: dimension(s, d, name),
        f"with {MART_SQL} select {', '.join(_columns)} from {_dim}",
    )
REG.add(
    "dim_date",
    lambda s, d: R.date_dimension(staged(s, d, "order_date")),
    f"""with {MART_SQL} select strftime(order_date, '%Y-%m-%d') as order_date,
    strftime(order_month, '%Y-%m-%d') as order_month, cast(order_year as bigint) as order_year,
    cast(order_month_number as bigint) as order_month_number from dim_date""",
)
MART_SELECTS = {
    "mart_sales_performance": """strftime(order_month, '%Y-%m-%d') as order_month, orders,
        cast(quantity as double) as quantity, cast(revenue as double) as revenue,
        cast(gross_margin as double) as gross_margin""",
    "mart_product_performance": """product_category, product_name, cast(quantity as double) as quantity,
        cast(revenue as double) as revenue, cast(gross_margin as double) as gross_margin""",
    "mart_customer_segments": """customer_segment, orders, cast(revenue as double) as revenue,
        average_order_value""",
    "mart_store_performance": """store_region, store_name, orders, cast(revenue as double) as revenue""",
}
for _mart, _select in MART_SELECTS.items():
    REG.add(
        _mart,
        lambda s, d, name=_mart: mart(s, d, name),
        f"with {MART_SQL} select {_select} from {_mart}",
    )

# ---- single cleaning rules over the feed -------------------------------------------------------

REG.add(
    "clean_text",
    lambda s, d: table(s, d, "documents").select(
        "doc_id", C.clean_text(F.concat(F.lit("  "), "lang", F.lit(" "))).alias("lang"),
        C.clean_text(F.when(F.col("lang") == "en", "   ").otherwise(F.col("source"))).alias("source"),
        C.clean_text(F.when(F.col("lang") == "fr", " NULL ").otherwise(F.col("text"))).alias("body"),
    ),
    """select doc_id, nullif(trim('  ' || lang || ' '), '') as lang,
      nullif(trim(case when lang = 'en' then '   ' else source end), '') as source,
      nullif(trim(case when lang = 'fr' then ' NULL ' else text end), '') as body from documents""",
)
DATE_TEXT = """case o_orderpriority
  when '1-URGENT' then date_format(o_orderdate, 'yyyy/MM/dd')
  when '2-HIGH' then date_format(o_orderdate, 'MM/dd/yyyy')
  when '3-MEDIUM' then date_format(o_orderdate, 'dd/MM/yyyy')
  when '4-NOT SPECIFIED' then date_format(o_orderdate, 'yyyy-MM')
  else date_format(o_orderdate, 'yyyy-MM-dd') end"""
REG.add(
    "cast_date",
    lambda s, d: table(s, d, "orders")
    .select("o_orderkey", F.expr(DATE_TEXT).alias("date_text"))
    .select("o_orderkey", "date_text", C.clean_date(F.col("date_text")).alias("parsed")),
    """with t as (select o_orderkey, case o_orderpriority
      when '1-URGENT' then strftime(o_orderdate, '%Y/%m/%d')
      when '2-HIGH' then strftime(o_orderdate, '%m/%d/%Y')
      when '3-MEDIUM' then strftime(o_orderdate, '%d/%m/%Y')
      when '4-NOT SPECIFIED' then strftime(o_orderdate, '%Y-%m')
      else strftime(o_orderdate, '%Y-%m-%d') end as date_text from orders)
    select o_orderkey, date_text, strftime(coalesce(try_strptime(date_text, '%Y-%m-%d'),
      try_strptime(date_text, '%Y/%m/%d'), try_strptime(date_text, '%m/%d/%Y'),
      try_strptime(date_text, '%d/%m/%Y')), '%Y-%m-%d') as parsed from t""",
)
NUMBER_TEXT = """case l_returnflag when 'R' then concat('qty ', cast(l_linenumber as string))
  when 'A' then '' else cast(cast(l_extendedprice as decimal(18,2)) as string) end"""
REG.add(
    "cast_number",
    lambda s, d: table(s, d, "lineitem")
    .select("l_orderkey", "l_linenumber", F.expr(NUMBER_TEXT).alias("number_text"))
    .withColumn("parsed", C.clean_whole_number(F.col("number_text"))),
    """with t as (select l_orderkey, cast(l_linenumber as bigint) as l_linenumber,
      case l_returnflag when 'R' then 'qty ' || l_linenumber when 'A' then ''
        else cast(cast(l_extendedprice as decimal(18,2)) as varchar) end as number_text from lineitem)
    select l_orderkey, l_linenumber, number_text, cast(try_cast(number_text as decimal(18,0)) as double) as parsed
    from t""",
)
REG.add(
    "cast_decimal",
    lambda s, d: table(s, d, "lineitem")
    .select(
        "l_orderkey",
        F.when(F.col("l_returnflag") == "R", F.lit("n/a"))
        .otherwise(F.concat(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("5")))
        .alias("number_text"),
    )
    .withColumn("parsed", C.clean_money(F.col("number_text"))),
    """with t as (select l_orderkey, case when l_returnflag = 'R' then 'n/a'
        else cast(cast(l_extendedprice as decimal(18,2)) as varchar) || '5' end as number_text from lineitem)
    select l_orderkey, number_text, cast(try_cast(number_text as decimal(18,2)) as double) as parsed from t""",
)
REG.add(
    "month_grain",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey", C.month_of(F.col("o_orderdate")).alias("order_month")
    ),
    "select o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as order_month from orders",
)
REG.add(
    "date_parts",
    lambda s, d: table(s, d, "events").select(
        "event_id", F.year("ts").alias("event_year"), F.month("ts").alias("event_month")
    ),
    """select event_id, cast(extract(year from ts) as bigint) as event_year,
      cast(extract(month from ts) as bigint) as event_month from events""",
)
REG.add(
    "net_revenue",
    lambda s, d: enriched(s, d, "order_line_id").select("order_line_id", "revenue", "net_revenue"),
    f"""with {INT_SQL} select order_line_id, cast(revenue as double) as revenue,
      cast(net_revenue as double) as net_revenue from int""",
)
REG.add(
    "gross_margin",
    lambda s, d: enriched(s, d, "order_line_id").select("order_line_id", "cost", "gross_margin"),
    f"""with {INT_SQL} select order_line_id, cast(cost as double) as cost,
      cast(gross_margin as double) as gross_margin from int""",
)
REG.add(
    "raw_row_count",
    lambda s, d: retail_feed(s, d, ["order_id"]).agg(F.count("*").alias("rows_loaded")),
    f"with {RAW_SQL} select count(*) as rows_loaded from raw",
)
MOVED_KEY = "case product_category when 'PROMO' then concat('OLD-', product_id) else product_id end"
REG.add(
    "fact_dim_left_join",
    lambda s, d: enriched(s, d, "order_line_id", "product_id")
    .join(
        # Some products stand under another key, so unmatched keys show up with NULL attributes.
        dimension(s, d, "dim_product").withColumn("product_id", F.expr(MOVED_KEY)), "product_id", "left"
    )
    .select("order_line_id", "product_id", "product_name", "product_category", "net_revenue"),
    f"""with {MART_SQL} select f.order_line_id, f.product_id, p.product_name, p.product_category,
      cast(f.net_revenue as double) as net_revenue from int f
      left join (select {MOVED_KEY} as product_id, product_name, product_category from dim_product) p on f.product_id = p.product_id""",
)
