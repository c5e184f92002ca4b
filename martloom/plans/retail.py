"""Fixed retail model: staging, enriched intermediate, dimensions, fact and four marts.

``RetailModel`` is lazy. Give it a raw frame and ask for a layer; nothing runs before an action.
``write`` turns every layer into a table so later layers read columns back instead of recomputing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions import cleaning as C
from martloom.operators import distinct_counts
from martloom.session import shuffles_dropped

TEXT_COLUMNS = (
    "order_id", "order_line_id", "customer_id", "customer_name", "customer_segment", "product_id",
    "product_name", "product_category", "store_id", "store_name", "store_region", "payment_method",
)
MONEY_COLUMNS = ("unit_price", "discount_amount", "revenue", "cost")
STAGING_ORDER = (
    "order_id", "order_line_id", "order_date", "customer_id", "customer_name", "customer_segment",
    "product_id", "product_name", "product_category", "store_id", "store_name", "store_region",
    "quantity", "unit_price", "discount_amount", "revenue", "cost", "payment_method",
)
FACT_COLUMNS = (
    "order_line_id", "order_id", "order_date", "order_month", "customer_id", "product_id", "store_id",
    "payment_method", "quantity", "unit_price", "discount_amount", "net_revenue", "cost", "gross_margin",
)
DIMENSIONS = {
    "dim_customer": ("customer_id", ("customer_id", "customer_name", "customer_segment")),
    "dim_product": ("product_id", ("product_id", "product_name", "product_category")),
    "dim_store": ("store_id", ("store_id", "store_name", "store_region")),
}
# What analysis plans may ask of each mart.
RETAIL_CATALOG = {
    "mart_sales_performance": {
        "grain": "one row per month",
        "dimensions": ["order_month"],
        "metrics": ["orders", "quantity", "revenue", "gross_margin"],
    },
    "mart_product_performance": {
        "grain": "one row per product category and product",
        "dimensions": ["product_category", "product_name"],
        "metrics": ["quantity", "revenue", "gross_margin"],
    },
    "mart_customer_segments": {
        "grain": "one row per customer segment",
        "dimensions": ["customer_segment"],
        "metrics": ["orders", "revenue", "average_order_value"],
    },
    "mart_store_performance": {
        "grain": "one row per store region and store",
        "dimensions": ["store_region", "store_name"],
        "metrics": ["orders", "revenue"],
    },
}


def stage(raw: DataFrame) -> DataFrame:
    """Clean and type the raw text columns that are present, in the staging order."""

    def typed(name: str):
        if name in TEXT_COLUMNS:
            return C.clean_text(F.col(name))
        if name == "order_date":
            return C.clean_date(F.col(name))
        if name == "quantity":
            return C.clean_whole_number(F.col(name))
        return C.clean_money(F.col(name))

    present = {name.lower() for name in raw.columns}
    return raw.select(*(typed(name).alias(name) for name in STAGING_ORDER if name in present))


def enrich(staged: DataFrame) -> DataFrame:
    """Add order month, net revenue and gross margin."""
    net = C.net_revenue(
        F.col("revenue"), F.col("quantity"), F.col("unit_price"), F.col("discount_amount")
    )
    return staged.withColumns(
        {
            "order_month": C.month_of(F.col("order_date")),
            "net_revenue": net,
            "gross_margin": C.gross_margin(net, F.col("cost")),
        }
    )


def dimension(enriched: DataFrame, name: str) -> DataFrame:
    """Distinct attribute rows with a key. A key with changed attributes keeps one row per variant."""
    key, columns = DIMENSIONS[name]
    return enriched.filter(F.col(key).isNotNull()).select(*columns).distinct()


def date_dimension(enriched: DataFrame) -> DataFrame:
    # Everything follows from the date, so only the date takes part in the shuffle.
    days = enriched.filter(F.col("order_date").isNotNull()).select("order_date").distinct()
    return days.select(
        "order_date",
        C.month_of(F.col("order_date")).alias("order_month"),
        F.year("order_date").alias("order_year"),
        F.month("order_date").alias("order_month_number"),
    )


def fact(enriched: DataFrame) -> DataFrame:
    return enriched.select(*FACT_COLUMNS)


def sales_mart(facts: DataFrame) -> DataFrame:
    return facts.groupBy("order_month").agg(
        F.count_distinct("order_id").alias("orders"),
        F.try_sum("quantity").alias("quantity"),
        F.try_sum("net_revenue").alias("revenue"),
        F.try_sum("gross_margin").alias("gross_margin"),
    )


def product_mart(facts: DataFrame, products: DataFrame) -> DataFrame:
    # Sums are taken per key before the join, so a product that holds a large share of the fact
    # reaches the join as one row. Attribute variants still fan out exactly as a row-level join.
    measures = ("quantity", "net_revenue", "gross_margin")
    per_key = facts.groupBy("product_id").agg(*(F.try_sum(m).alias(m) for m in measures))
    return (
        per_key.join(products, "product_id", "left")
        .groupBy("product_category", "product_name")
        .agg(
            F.try_sum("quantity").alias("quantity"),
            F.try_sum("net_revenue").alias("revenue"),
            F.try_sum("gross_margin").alias("gross_margin"),
        )
    )


def _orders_by_key(facts: DataFrame, key: str) -> DataFrame:
    return facts.groupBy(key, "order_id").agg(F.try_sum("net_revenue").alias("net_revenue"))


def segment_mart(facts: DataFrame, customers: DataFrame) -> DataFrame:
    joined = _orders_by_key(facts, "customer_id").join(customers, "customer_id", "left")
    totals = joined.groupBy("customer_segment").agg(
        F.count_distinct("order_id").alias("orders"), F.try_sum("net_revenue").alias("revenue")
    )
    return totals.withColumn("average_order_value", C.safe_ratio(F.col("revenue"), F.col("orders")))


def store_mart(facts: DataFrame, stores: DataFrame) -> DataFrame:
    joined = _orders_by_key(facts, "store_id").join(stores, "store_id", "left")
    return joined.groupBy("store_region", "store_name").agg(
        F.count_distinct("order_id").alias("orders"), F.try_sum("net_revenue").alias("revenue")
    )


# The marts that count orders, and the dimension each takes its own dimensions from.
ORDER_MARTS = {"mart_sales_performance": None, "mart_customer_segments": "dim_customer", "mart_store_performance": "dim_store"}


def order_members(facts: DataFrame, mart: str, keys: DataFrame | None, numbers: DataFrame) -> DataFrame:
    """The orders of each group of a mart as bitmaps, for true counts over fewer dimensions. ``keys`` is the mart's dimension table."""
    dimensions = RETAIL_CATALOG[mart]["dimensions"]
    if keys is None:
        return distinct_counts.members(facts, dimensions, "order_id", numbers)
    key = DIMENSIONS[ORDER_MARTS[mart]][0]
    # Bitmaps are made per key before the join, so a key with much of the fact meets its attributes as few rows.
    per_key = distinct_counts.members(facts, [key], "order_id", numbers)
    return distinct_counts.coarser(per_key.join(keys, key, "left"), dimensions)


class RetailModel:
    """The retail layers over one raw frame, or over tables already written by ``write``."""

    LAYERS = {
        "staging": ("stg_retail_transactions",),
        "intermediate": ("int_retail_sales_enriched",),
        "dimensional_model": ("dim_customer", "dim_product", "dim_store", "dim_date", "fact_sales"),
        "data_marts": (
            "mart_sales_performance", "mart_product_performance", "mart_customer_segments",
            "mart_store_performance",
        ),
    }

    def __init__(self, raw: DataFrame):
        self.raw = raw
        self._models: dict[str, DataFrame] = {}

    def model(self, name: str) -> DataFrame:
        if name not in self._models:
            self._models[name] = self._build(name)
        return self._models[name]

    def _build(self, name: str) -> DataFrame:
        if name in DIMENSIONS:
            return dimension(self.model("int_retail_sales_enriched"), name)
        builders: dict[str, Callable[[], DataFrame]] = {
            "stg_retail_transactions": lambda: stage(self.raw),
            "int_retail_sales_enriched": lambda: enrich(self.model("stg_retail_transactions")),
            "dim_date": lambda: date_dimension(self.model("int_retail_sales_enriched")),
            "fact_sales": lambda: fact(self.model("int_retail_sales_enriched")),
            "mart_sales_performance": lambda: sales_mart(self.model("fact_sales")),
            "mart_product_performance": lambda: product_mart(
                self.model("fact_sales"), self.model("dim_product")
            ),
            "mart_customer_segments": lambda: segment_mart(
                self.model("fact_sales"), self.model("dim_customer")
            ),
            "mart_store_performance": lambda: store_mart(
                self.model("fact_sales"), self.model("dim_store")
            ),
        }
        return builders[name]()

    def write(self, writer: Callable[[str, DataFrame], DataFrame]) -> dict[str, DataFrame]:
        """Materialise every model in layer order; each later model reads the written ones.

        One model is written after the other, and what was shuffled for it is deleted before the next one begins, so that the
        disk holds the tables and the shuffles of one model.
        """
        with shuffles_dropped(self.raw.sparkSession):
            for names in self.LAYERS.values():
                planned = [(name, self.model(name)) for name in names]
                self._models |= {name: writer(name, df) for name, df in planned}
        return dict(self._models)
