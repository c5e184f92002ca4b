"""Spec-driven models over the invoice feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.plans import spec as S
from martloom.registry.common import Registry
from martloom.sources.feeds import INVOICE_CONTRACT, invoice_feed

REG = Registry()

ROLES = {
    **{c: "identifier" for c in (
        "invoice_id", "invoice_line_id", "customer_id", "product_id", "supplier_id", "warehouse_id")},
    **{c: "date_time" for c in ("invoice_date", "ship_date")},
    **{c: "measure_column" for c in (
        "quantity", "unit_price", "discount_amount", "net_revenue", "unit_cost", "gross_margin")},
}
MAPPINGS = [S.Mapping(c, c, ROLES.get(c, "dimension")) for c in INVOICE_CONTRACT]
SPEC = S.ModelSpec(
    fact="fact_invoice_lines",
    grain="one row per invoice line",
    keys=("invoice_line_id", "invoice_id"),
    measures=("quantity", "net_revenue", "gross_margin"),
    dates=("invoice_date",),
    degenerate=("channel",),
    dimensions=(
        S.Dimension(
            "dim_customer", "customer_id",
            ("customer_id", "customer_name", "customer_segment", "customer_region"),
        ),
        S.Dimension("dim_product", "product_id", ("product_id", "product_name", "product_category")),
        S.Dimension("dim_warehouse", "warehouse_id", ("warehouse_id", "warehouse_region")),
    ),
    marts=(
        S.Mart("mart_monthly_revenue", "one row per invoice month", ("invoice_date_month",),
               ("net_revenue", "gross_margin")),
        S.Mart("mart_product_performance", "one row per product category", ("product_category",),
               ("net_revenue", "quantity")),
        S.Mart("mart_customer_segments", "one row per customer segment", ("customer_segment",),
               ("net_revenue", "gross_margin")),
        S.Mart("mart_channel_mix", "one row per channel, segment and warehouse region",
               ("channel", "customer_segment", "warehouse_region"), ("net_revenue", "quantity")),
    ),
)

RAW_SQL = """
raw as (
  select cast(l_orderkey as varchar) as invoice_id, l_orderkey || '-' || l_linenumber as invoice_line_id,
    strftime(o_orderdate, '%Y-%m-%d') as invoice_date, strftime(l_shipdate, '%Y-%m-%d') as ship_date,
    cast(c_custkey as varchar) as customer_id, c_name as customer_name, c_mktsegment as customer_segment,
    cr.r_name as customer_region, cn.n_name as account_manager, cast(p_partkey as varchar) as product_id,
    p_name as product_name, p_type as product_category, cast(s_suppkey as varchar) as supplier_id,
    s_name as supplier_name, cast(s_nationkey as varchar) as warehouse_id, sr.r_name as warehouse_region,
    l_returnflag as channel, cast(cast(l_quantity as decimal(38,0)) as varchar) as quantity,
    cast(cast(p_retailprice as decimal(18,2)) as varchar) as unit_price,
    cast(cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(18,2)) as decimal(18,2)) as varchar) as discount_amount,
    cast(cast(l_extendedprice as decimal(18,2)) as varchar) as net_revenue,
    cast(cast(cast(p_retailprice as decimal(18,2)) * cast(0.60 as decimal(3,2)) as decimal(18,2)) as varchar) as unit_cost,
    cast(cast(cast(l_extendedprice as decimal(18,2)) * cast(0.40 as decimal(3,2)) as decimal(18,2)) as varchar) as gross_margin,
    l_linestatus as payment_terms, o_orderpriority as order_priority
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation cn on c_nationkey = cn.n_nationkey join region cr on cn.n_regionkey = cr.r_regionkey
  join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join nation sn on s_nationkey = sn.n_nationkey join region sr on sn.n_regionkey = sr.r_regionkey
)"""
NUMBERS = ("quantity", "unit_price", "discount_amount", "net_revenue", "unit_cost", "gross_margin")
DATES = ("invoice_date", "ship_date")
STG_SQL = RAW_SQL + ", stg as (select " + ", ".join(
    f"nullif(trim({c}), '') as {c}" for c in INVOICE_CONTRACT
) + " from raw)"


def _typed(c: str) -> str:
    if c in NUMBERS:
        return f"try_cast({c} as decimal(18,2)) as {c}"
    if c in DATES:
        return f"cast(try_strptime({c}, '%Y-%m-%d') as date) as {c}"
    return c


INT_SQL = STG_SQL + ", inter as (select " + ", ".join(_typed(c) for c in INVOICE_CONTRACT) + """,
  cast(date_trunc('month', try_strptime(invoice_date, '%Y-%m-%d')) as date) as invoice_date_month from stg)"""
DIM_SQL = INT_SQL + "".join(
    f", {d.name} as (select distinct {', '.join(d.columns)} from inter where {d.key} is not null)"
    for d in SPEC.dimensions
)


def _shown(c: str) -> str:
    if c in NUMBERS:
        return f"cast({c} as double) as {c}"
    if c in (*DATES, "invoice_date_month"):
        return f"strftime({c}, '%Y-%m-%d') as {c}"
    return c


def mapped(*names: str) -> list[S.Mapping]:
    return [m for m in MAPPINGS if m.name in names] if names else MAPPINGS


def inter(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """Intermediate rows for the named columns only; months follow their dates."""
    use = mapped(*names)
    dates = tuple(d for d in SPEC.dates if d in {m.name for m in use})
    part = S.ModelSpec(SPEC.fact, (), (), dates, (), ())
    return S.intermediate(S.staged(invoice_feed(spark, sf, [m.raw_name for m in use]), use), use, part)


def dim(spark: SparkSession, sf: str, name: str) -> DataFrame:
    wanted = next(d for d in SPEC.dimensions if d.name == name)
    return S.dimension(inter(spark, sf, *wanted.columns), wanted)


def fact(spark: SparkSession, sf: str) -> DataFrame:
    return S.fact(inter(spark, sf, *SPEC.fact_columns()), SPEC)


def mart(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Only the fact columns and dimensions the mart touches are read."""
    wanted = next(m for m in SPEC.marts if m.name == name)
    held = set(SPEC.fact_columns())
    owners = {SPEC.owner_of(c) for c in wanted.dimensions if c not in held}
    columns = {d.key for d in owners} | set(wanted.metrics)
    columns |= {c.removesuffix("_month") for c in wanted.dimensions if c in held}
    dims = {d.name: dim(spark, sf, d.name) for d in owners}
    return S.mart(inter(spark, sf, *columns), dims, SPEC, wanted)


REG.add("spec_staging", lambda s, d: S.staged(invoice_feed(s, d), MAPPINGS),
        f"with {STG_SQL} select {', '.join(INVOICE_CONTRACT)} from stg")
REG.add("spec_intermediate", lambda s, d: inter(s, d),
        f"with {INT_SQL} select {', '.join(_shown(c) for c in INVOICE_CONTRACT)}, "
        f"{_shown('invoice_date_month')} from inter")
REG.add("spec_fact", fact,
        f"with {INT_SQL} select {', '.join(_shown(c) for c in SPEC.fact_columns())} from inter")
for _d in SPEC.dimensions:
    REG.add(f"spec_{_d.name}", lambda s, d, name=_d.name: dim(s, d, name),
            f"with {DIM_SQL} select {', '.join(_d.columns)} from {_d.name}")
SUMS = "cast(sum({0}) as double) as {0}"
REG.add("spec_mart_month", lambda s, d: mart(s, d, "mart_monthly_revenue"),
        f"""with {INT_SQL}, m as (select invoice_date_month, sum(net_revenue) as net_revenue,
        sum(gross_margin) as gross_margin from inter group by 1)
        select {_shown('invoice_date_month')}, {_shown('net_revenue')}, {_shown('gross_margin')} from m""")
REG.add("spec_mart_product", lambda s, d: mart(s, d, "mart_product_performance"),
        f"""with {DIM_SQL} select p.product_category, cast(sum(f.net_revenue) as double) as net_revenue,
        cast(sum(f.quantity) as double) as quantity from inter f
        left join dim_product p on f.product_id = p.product_id group by 1""")
REG.add("spec_mart_segment", lambda s, d: mart(s, d, "mart_customer_segments"),
        f"""with {DIM_SQL} select c.customer_segment, cast(sum(f.net_revenue) as double) as net_revenue,
        cast(sum(f.gross_margin) as double) as gross_margin from inter f
        left join dim_customer c on f.customer_id = c.customer_id group by 1""")
REG.add("spec_mart_multi_dim", lambda s, d: mart(s, d, "mart_channel_mix"),
        f"""with {DIM_SQL} select f.channel, c.customer_segment, w.warehouse_region,
        cast(sum(f.net_revenue) as double) as net_revenue, cast(sum(f.quantity) as double) as quantity
        from inter f left join dim_customer c on f.customer_id = c.customer_id
        left join dim_warehouse w on f.warehouse_id = w.warehouse_id group by 1, 2, 3""")

RENAMED = [
    S.Mapping("invoice_id", "document_no", "identifier"),
    S.Mapping("customer_name", "client", "dimension"),
    S.Mapping("net_revenue", "net_amount", "measure_column"),
]
REG.add(
    "mapped_projection",
    lambda s, d: S.staged(invoice_feed(s, d, [m.raw_name for m in RENAMED]), RENAMED),
    f"""with {RAW_SQL} select nullif(trim(invoice_id), '') as document_no,
    nullif(trim(customer_name), '') as client, nullif(trim(net_revenue), '') as net_amount from raw""",
)
