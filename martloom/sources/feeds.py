"""Raw text feeds: one wide, denormalised, all-text row per order line.

The feeds stand in for uploaded files. They hang dimension columns off ``lineitem`` along foreign
keys whose targets are unique, so a join whose columns nobody asked for cannot change the rows and
is left out. Lines are shuffled for parts and once more for orders, which have met their customers by then, so
they are at their narrowest when they move. Suppliers are broadcast up to a counted million; elsewhere Spark
broadcasts a side when its size allows it and shuffles (with skew handling) when it does not.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BROADCAST = 1_000_000  # suppliers (about 100 bytes each) up to which they are broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money(col: Column) -> Column:
    return col.cast("decimal(18,2)")


def _tagged(prefix: str, name: str) -> Column:
    return F.concat(F.lit(prefix), F.col(name).cast("string"))


def _line_key(prefix: str) -> Column:
    return F.concat(
        F.lit(prefix), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")
    )


def _retail_columns() -> dict[str, tuple[set[str], Column]]:
    price = _money(F.col("l_extendedprice"))
    return {
        "order_id": (set(), _tagged("ORD-", "l_orderkey")),
        "order_line_id": (set(), _line_key("LINE-")),
        "order_date": ({"orders"}, F.date_format("o_orderdate", "yyyy-MM-dd")),
        "customer_id": ({"orders"}, _tagged("CUST-", "o_custkey")),
        "customer_name": ({"customer"}, F.col("c_name")),
        "customer_segment": ({"customer"}, F.col("c_mktsegment")),
        "product_id": (set(), _tagged("PROD-", "l_partkey")),
        "product_name": ({"part"}, F.col("p_name")),
        "product_category": ({"part"}, F.col("p_type")),
        "store_id": (set(), _tagged("STORE-", "l_suppkey")),
        "store_name": ({"supplier"}, F.col("s_name")),
        "store_region": ({"supplier_region"}, F.col("s_region")),
        "quantity": (set(), F.col("l_quantity").cast("decimal(38,0)").cast("string")),
        "unit_price": ({"part"}, _money(F.col("p_retailprice")).cast("string")),
        "discount_amount": (set(), _money(price * _money(F.col("l_discount"))).cast("string")),
        # Returned lines state no revenue, so the arithmetic fallback has work to do.
        "revenue": (set(), F.when(F.col("l_returnflag") == "R", "").otherwise(price.cast("string"))),
        "cost": (set(), _money(price * F.lit(0.60).cast("decimal(3,2)")).cast("string")),
        "payment_method": (set(), F.when(F.col("l_linestatus") == "O", "Invoice").otherwise("Cash")),
    }


def _invoice_columns() -> dict[str, tuple[set[str], Column]]:
    price = _money(F.col("l_extendedprice"))
    return {
        "invoice_id": (set(), F.col("l_orderkey").cast("string")),
        "invoice_line_id": (set(), _line_key("")),
        "invoice_date": ({"orders"}, F.date_format("o_orderdate", "yyyy-MM-dd")),
        "ship_date": (set(), F.date_format("l_shipdate", "yyyy-MM-dd")),
        "customer_id": ({"orders"}, F.col("o_custkey").cast("string")),
        "customer_name": ({"customer"}, F.col("c_name")),
        "customer_segment": ({"customer"}, F.col("c_mktsegment")),
        "customer_region": ({"customer_region"}, F.col("c_region")),
        "account_manager": ({"customer_region"}, F.col("c_nation")),
        "product_id": (set(), F.col("l_partkey").cast("string")),
        "product_name": ({"part"}, F.col("p_name")),
        "product_category": ({"part"}, F.col("p_type")),
        "supplier_id": (set(), F.col("l_suppkey").cast("string")),
        "supplier_name": ({"supplier"}, F.col("s_name")),
        "warehouse_id": ({"supplier"}, F.col("s_nationkey").cast("string")),
        "warehouse_region": ({"supplier_region"}, F.col("s_region")),
        "channel": (set(), F.col("l_returnflag")),
        "quantity": (set(), F.col("l_quantity").cast("decimal(38,0)").cast("string")),
        "unit_price": ({"part"}, _money(F.col("p_retailprice")).cast("string")),
        "discount_amount": (set(), _money(price * _money(F.col("l_discount"))).cast("string")),
        "net_revenue": (set(), price.cast("string")),
        "unit_cost": (
            {"part"},
            _money(_money(F.col("p_retailprice")) * F.lit(0.60).cast("decimal(3,2)")).cast("string"),
        ),
        "gross_margin": (set(), _money(price * F.lit(0.40).cast("decimal(3,2)")).cast("string")),
        "payment_terms": (set(), F.col("l_linestatus")),
        "order_priority": ({"orders"}, F.col("o_orderpriority")),
    }


RETAIL_CONTRACT = (
    "order_id", "order_line_id", "order_date", "customer_id", "customer_name", "customer_segment",
    "product_id", "product_name", "product_category", "store_id", "store_name", "store_region",
    "quantity", "unit_price", "discount_amount", "revenue", "cost", "payment_method",
)
INVOICE_CONTRACT = (
    "invoice_id", "invoice_line_id", "invoice_date", "ship_date", "customer_id", "customer_name",
    "customer_segment", "customer_region", "account_manager", "product_id", "product_name",
    "product_category", "supplier_id", "supplier_name", "warehouse_id", "warehouse_region", "channel",
    "quantity", "unit_price", "discount_amount", "net_revenue", "unit_cost", "gross_margin",
    "payment_terms", "order_priority",
)


def _attach(spark: SparkSession, sf_dir: str, needed: set[str], most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    if "part" in needed:
        lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if needed & {"orders", "customer", "customer_region"}:
        orders = table(spark, sf_dir, "orders")
        if needed & {"customer", "customer_region"}:
            customers = table(spark, sf_dir, "customer")
            if "customer_region" in needed:
                customers = _with_region(spark, sf_dir, customers, "c_nationkey", "c_nation", "c_region")
            orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if needed & {"supplier", "supplier_region"}:
        suppliers = table(spark, sf_dir, "supplier")
        few = suppliers.count() <= most_broadcast
        if "supplier_region" in needed:
            suppliers = _with_region(spark, sf_dir, suppliers, "s_nationkey", "s_nation", "s_region")
        lines = lines.join(F.broadcast(suppliers) if few else suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return lines


def _with_region(
    spark: SparkSession, sf_dir: str, df: DataFrame, key: str, nation_name: str, region_name: str
) -> DataFrame:
    nations = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("n_nationkey", F.col("n_name").alias(nation_name), F.col("r_name").alias(region_name))
    )
    return df.join(nations, F.col(key) == F.col("n_nationkey"), "left").drop("n_nationkey")


def _feed(
    spark: SparkSession,
    sf_dir: str,
    available: dict[str, tuple[set[str], Column]],
    columns: Iterable[str] | None,
) -> DataFrame:
    names = list(columns) if columns is not None else list(available)
    needed = set().union(*(available[name][0] for name in names))
    return _attach(spark, sf_dir, needed).select(*(available[name][1].alias(name) for name in names))


def retail_feed(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Retail transactions as text; ``columns`` limits both the output and the joins behind it."""
    return _feed(spark, sf_dir, _retail_columns(), columns)


def invoice_feed(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Business invoice lines as text; ``columns`` limits both the output and the joins behind it."""
    return _feed(spark, sf_dir, _invoice_columns(), columns)
