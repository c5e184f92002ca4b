"""Machine-made payloads shaped from the plain tables: mappings, specs, plans.

One payload per row of the table behind it. Parts of each document follow the row's values, so good
and faulty documents of every sort occur, in numbers that grow with the table. Select lists use only
syntax any SQL engine reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.sources.feeds import RETAIL_CONTRACT, table

ROLES = (
    "identifier", "identifier", "date_time", "identifier", "dimension", "dimension", "identifier", "dimension",
    "dimension", "identifier", "dimension", "dimension", "measure_column", "measure_column", "measure_column",
    "metric_candidate", "measure_column", "dimension",
)
TYPES = (
    "identifier", "identifier", "date", "identifier", "string", "string", "identifier", "string", "string",
    "identifier", "string", "string", "integer", "decimal", "decimal", "decimal", "decimal", "string",
)
CONTRACT = tuple((i, c, r, t) for i, (c, r, t) in enumerate(zip(RETAIL_CONTRACT, ROLES, TYPES)))

MAPPING_COLUMNS = (
    "c_custkey as dataset_id", "column_index", "raw_column_name", "raw_column_name as suggested_name",
    "semantic_role", "detected_type", "0.9 as confidence",
    """case when column_index = 5 and c_nationkey % 5 = 0 then 'customer segment'
      when column_index = 16 and c_nationkey % 2 = 0 then 'unit_cost' when column_index = 7 then '' end as approved_name""",
    """case when column_index = 11 and c_nationkey % 3 = 0 then 'unknown'
      when column_index = 4 and c_nationkey % 4 = 1 then 'measure_column' end as approved_role""",
    "not (column_index = 13 and c_nationkey % 2 = 1) as include_in_model",
)
EDIT_COLUMNS = (
    "c_custkey as dataset_id", "cast(c_custkey % 16 + 4 as bigint) as column_index",
    "case when c_acctbal < 0 then 'not a name' else ' renamed_column ' end as approved_name",
    "case when c_nationkey = 3 then 'metric' else 'dimension' end as approved_role",
    "c_nationkey % 2 = 0 as include_in_model",
)


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighteen mapping rows per dataset, one per column of the retail contract."""
    contract = F.array(
        *(
            F.struct(
                F.lit(i).cast("long").alias("column_index"), F.lit(c).alias("raw_column_name"),
                F.lit(r).alias("semantic_role"), F.lit(t).alias("detected_type"),
            )
            for i, c, r, t in CONTRACT
        )
    )
    return table(spark, sf_dir, "customer").select("*", F.inline(contract)).selectExpr(*MAPPING_COLUMNS)


CONTRACT_SQL = "contract(column_index, raw_column_name, semantic_role, detected_type) as (values " + ", ".join(
    f"({i}, '{c}', '{r}', '{t}')" for i, c, r, t in CONTRACT
) + ")"
MAPPINGS_SQL = f"{CONTRACT_SQL}, mappings as (select {', '.join(MAPPING_COLUMNS)} from customer cross join contract)"

SUGGESTION_PAYLOAD = """case when c_nationkey = 7 then 'no json' when c_nationkey = 8 then '{"columns": []}'
  when c_nationkey = 9 then '{"columns": [], "note": "api_key"}' else concat(
  '{"columns": [{"raw_column_name": "order_id", "suggested_name": "', case when c_custkey % 3 = 0 then 'order id' else 'order_no' end,
  '", "semantic_role": "', case when c_custkey % 4 = 0 then 'key' else 'identifier' end,
  '", "confidence": ', case when c_custkey % 5 = 0 then '1.25' when c_custkey % 5 = 1 then '"0.9"' when c_custkey % 5 = 2 then '0.5' else '0.98765' end,
  ', "needs_review": ', case when c_custkey % 2 = 0 then 'true' else 'false' end, ', "reason": "Unique per order"}, ',
  '{"raw_column_name": "', case when c_custkey % 6 = 0 then 'order_id' when c_custkey % 6 = 1 then 'no_such_column' else 'cost' end,
  '", "suggested_name": "cost", "semantic_role": "', case when c_custkey % 7 = 0 then 'unknown' else 'measure_column' end,
  '", "confidence": 1, "reason": "', case when c_custkey % 8 = 0 then '  ' else c_mktsegment end, '"}]}') end"""

PROPOSAL_PAYLOAD = """case when c_nationkey = 11 and c_custkey % 2 = 0 then '{"grain": 1' when c_nationkey = 12 and c_custkey % 2 = 0 then '{"grain": "the password is"}' else concat(
  '{"grain": "', case when c_custkey % 19 = 0 then ' ' else 'one row  per order line' end,
  '", "fact_table": {"name": "', case when c_mktsegment = 'BUILDING' and c_custkey % 3 = 0 then 'sales lines' else 'fact_sales' end,
  '", "keys": ["order_line_id", "order_id", "order_id"', case when c_custkey % 31 = 2 then ', "order_id", "order_id", "order_id", "no_such_key"' else '' end, '], "measures": ["quantity", "',
  case when c_custkey % 11 = 0 then 'customer_name' when c_custkey % 11 = 1 then 'amount' else 'revenue' end,
  '"], "degenerate_dimensions": ', case when c_custkey % 13 = 0 then '"payment_method"' when c_custkey % 13 = 1 then '["discount_amount"]' else '["payment_method"]' end,
  ', "date_columns": ["', case when c_custkey % 17 = 0 then 'store_name' else 'order_date' end, '"]}, ',
  '"dimensions": [{"name": "dim_customer", "key_column": "customer_id", "columns": ["customer_name", "customer_segment"]}, ',
  '{"name": "', case when c_custkey % 7 = 0 then 'dim_customer' when c_custkey % 7 = 1 then 'product' else 'dim_product' end,
  '", "key_column": "', case when c_custkey % 23 = 0 then 'quantity' else 'product_id' end,
  '", "columns": ["product_id", "product_name"', case when c_custkey % 5 = 0 then ', "unit_price"' when c_custkey % 5 = 1 then ', "colour"' else '' end, ']}',
  case when c_custkey % 31 = 0 then concat(', {"name": "dim_a", "key_column": "store_id", "columns": ["store_id"]}, {"name": "dim_b", "key_column": "store_id", "columns": ["store_id"]}, ',
    '{"name": "dim_c", "key_column": "store_id", "columns": ["store_id"]}, {"name": "dim_d", "key_column": "store_id", "columns": ["store_id"]}, ',
    '{"name": "seventh", "key_column": "store_id", "columns": ["store_id"]}') else '' end, '], ',
  '"marts": [{"name": "mart_monthly_revenue", "grain": "one row per month", "dimensions": ["order_date_month"], "metrics": ["revenue"]}, ',
  '{"name": "', case when c_custkey % 9 = 0 then 'mart_monthly_revenue' else 'mart_product_sales' end,
  '", "dimensions": [', case when c_custkey % 4 = 0 then '"product_name", "store_region"' when c_custkey % 4 = 1 then '"shelf"' else '"product_name", "customer_segment"' end,
  '], "metrics": [', case when c_custkey % 29 = 0 then '' when c_custkey % 29 = 1 then '"cost"' else '"quantity"' end, ']}',
  case when c_custkey % 31 = 1 then concat(', {"name": "mart_a", "dimensions": ["product_name"], "metrics": ["quantity"]}, {"name": "mart_b", "dimensions": ["product_name"], "metrics": ["quantity"]}, ',
    '{"name": "mart_c", "grain": 5, "dimensions": ["product_name"], "metrics": ["quantity"]}') else '' end, ']}') end"""

PLAN_PAYLOAD = """case when o_custkey % 41 = 0 then 'plan: none' when o_custkey % 41 = 1 then '{"sql": "select 1"}'
  when o_custkey % 41 = 2 then '["secret"]' else concat(
  '{"decision_type": "', case when o_orderpriority = '5-LOW' then 'needs_user_confirmation' when o_custkey % 37 = 0 then 'drop' else 'create_new' end,
  '", "question": "', case when o_custkey % 31 = 0 then ' ' else o_orderpriority end,
  '", "intent": ', case when o_custkey % 8 = 0 then 'null' when o_custkey % 8 = 1 then '"two words"' else '"trend"' end,
  ', "source_model": "', case o_custkey % 6 when 0 then 'mart_sales_performance' when 1 then 'mart_product_performance'
     when 2 then 'mart_customer_segments' when 3 then 'mart_store_performance' when 4 then 'mart_sales_performance' else 'mart_of_nothing' end,
  '", "metrics": [', case when o_orderkey % 17 = 0 then '' else concat('{"name": "',
     case o_orderkey % 5 when 0 then 'orders' when 1 then 'quantity' when 2 then 'gross_margin' else 'revenue' end,
     '", "aggregation": "', case o_orderkey % 7 when 0 then 'sum' when 1 then 'AVG' when 2 then 'count' when 3 then 'min' when 4 then 'max' when 5 then 'median' else ' sum ' end, '"}',
     case when o_orderkey % 3 = 0 then ', {"name": "revenue", "aggregation": "max"}' else '' end) end,
  '], "dimensions": ', case o_custkey % 5 when 0 then '["order_month"]' when 1 then '["product_category", "product_category"]'
     when 2 then '["customer_segment"]' when 3 then '["store_region"]' else '"order_month"' end,
  ', "filters": [', case when o_orderkey % 4 = 0 then concat('{"field": "', case when o_orderkey % 8 = 0 then 'order_month' else 'revenue' end,
     '", "operator": "', case when o_orderkey % 12 = 0 then '>' else '!=' end, '", "value": ',
     case when o_orderkey % 20 = 0 then '{"a": 1}' when o_orderkey % 20 = 4 then 'null' else '"x"' end, '}') else '' end,
  '], "sort": [{"field": "', case when o_orderkey % 6 = 0 then 'gross_margin' when o_orderkey % 6 = 1 then 'profit' else 'revenue' end,
  '", "direction": "', case when o_orderkey % 10 = 0 then 'up' when o_orderkey % 10 = 1 then 'DESC' else 'asc' end,
  '"}], "limit": ', case o_orderkey % 9 when 0 then '"20"' when 1 then '12.5' when 2 then '9999' else '25' end, '}') end"""


def suggestion_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as dataset_id", f"{SUGGESTION_PAYLOAD} as payload")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as proposal_id", "c_custkey as dataset_id", f"{PROPOSAL_PAYLOAD} as payload"
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as plan_id", f"{PLAN_PAYLOAD} as payload")
