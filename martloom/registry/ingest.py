"""Raw loads, header rules, file checks and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.functions.names import is_safe_name
from martloom.operators import charts, profiling
from martloom.plans.analysis import AnalysisPlan, run_plan
from martloom.plans.retail import RetailModel
from martloom.registry.common import Registry
from martloom.registry.profiling import EVENTS_SQL, events_text, long_sql
from martloom.registry.retail import MART_SQL, mart
from martloom.session import scratch_folder
from martloom.sources import files, positions, quoted, raw_csv, sinks
from martloom.sources.feeds import retail_feed, table
from martloom.sources.inline import rows as inline_rows

REG = Registry()


CUSTOMER_TEXT = (
    "cast(c_custkey as {text}) as customer_id",
    """concat('"', c_name, '", ', c_mktsegment) as label""",
    """case c_mktsegment when 'BUILDING' then 'NULL' when 'MACHINERY' then 'null' when 'FURNITURE' then ''
    when 'HOUSEHOLD' then ' NULL ' else c_mktsegment end as segment""", "c_nationkey",
)
# Lines of a file whose header has another order than the load asks for; some have a cell too many or too few.
CUSTOMER_LINE = """concat('"', replace(label, '"', '""'), '",', customer_id, case c_nationkey when 5 then '' else concat(',', segment) end,
  case c_nationkey when 3 then ',more' else '' end)"""
CUSTOMER_COLUMNS = ("customer_id", "label", "segment")


def customer_files(spark: SparkSession, sf: str) -> str:
    """Writes the customers as CSV lines, each file under its header, and returns the folder."""
    lines = table(spark, sf, "customer").selectExpr(*(c.format(text="string") for c in CUSTOMER_TEXT)).select(
        F.expr(CUSTOMER_LINE).alias("label,customer_id,segment")
    )
    path = scratch_folder(spark, "raw-load")
    # Marks that do not occur, so that lines are written as they are.
    marks = {"header": "true", "sep": "\x01", "quote": "\x02", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines.write.options(**marks).csv(path)
    return path


CUSTOMER_SQL = f"t as (select {', '.join(CUSTOMER_TEXT).format(text='varchar')} from customer)"


@REG.query(
    "raw_load",
    f"""with {CUSTOMER_SQL}
    select customer_id, label, case when segment in ('', 'NULL', 'null') then null else segment end as segment from t
    where c_nationkey not in (3, 5)""",
)
def raw_load(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as quoted CSV, then loaded back as raw text: the lines that fit their header."""
    return raw_csv.read_raw_csv(spark, customer_files(spark, sf), list(CUSTOMER_COLUMNS))


@REG.query(
    "raw_diverted",
    f"""with {CUSTOMER_SQL} select {CUSTOMER_LINE} as line, case c_nationkey when 3 then 4 else 2 end as n_cells, label as first_cell from t where c_nationkey in (3, 5)""",
)
def raw_diverted(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the same files that the load leaves out."""
    return raw_csv.diverted_rows(spark, customer_files(spark, sf), list(CUSTOMER_COLUMNS))


QUOTED_COLUMNS = ("doc_id", "source", "text")


@REG.query(
    "quoted_load",
    f"""select {', '.join(f"case when c.{c} in ('', 'NULL', 'null') then null else c.{c} end as {c}" for c in QUOTED_COLUMNS)}
    from (select cast(doc_id as varchar) as doc_id, source, text from documents) c""",
)
def quoted_load(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as CSV, line breaks and all, then loaded back from all splits of the files."""
    path = scratch_folder(spark, "quoted-load")
    raw_csv.write_csv(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text"), path)
    return quoted.read_quoted_csv(spark, path, list(QUOTED_COLUMNS))


REG.add(
    "raw_preview",
    lambda s, d: raw_csv.preview(
        table(s, d, "customer"), [("c_custkey", "Customer No"), ("c_name", "Full Name")], ["c_custkey"], 25
    ),
    """select c_custkey as "Customer No", c_name as "Full Name" from customer order by c_custkey limit 25""",
)


def event_files(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text, written to several CSV files in order of their ids, and read back without an order column.

    Some lines have a cell too many; they are left out, but count as lines.
    """
    cells = events_text(spark, sf).select("pos", *PLACED_COLUMNS)
    line = F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in PLACED_COLUMNS))
    wide = F.concat(line, F.when(F.col("pos") % 50 == 7, F.lit(',"more"')).otherwise(""))
    path = scratch_folder(spark, "event-files")
    marks = {"header": "true", "sep": "\x01", "quote": "\x02", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    ordered = cells.select("pos", wide.alias(",".join(PLACED_COLUMNS))).repartitionByRange(5, "pos").sortWithinPartitions("pos").drop("pos")
    ordered.write.options(**marks).csv(path)
    return raw_csv.read_raw_csv(spark, path, list(PLACED_COLUMNS), positions=True)


PLACED_COLUMNS = ("event_id", "event_day", "amount", "units", "note", "props")
PLACED_SQL = f"""{EVENTS_SQL}, placed as (select row_number() over (order by pos) - 1 as line_no, * from ev),
  lines as (select line_no as pos, {', '.join(f"case when {c} in ('', 'NULL', 'null') then null else {c} end as {c}" for c in PLACED_COLUMNS)} from placed where pos % 50 <> 7)"""
REG.add(
    "file_positions",
    lambda s, d: event_files(s, d).select("event_id", F.col(positions.LOAD_ROW).alias("load_row")),
    f"with {PLACED_SQL} select event_id, pos as load_row from lines",
)
REG.add(
    "file_preview",
    lambda s, d: raw_csv.preview(event_files(s, d), [("event_id", "Event No"), ("event_day", "Day"), ("amount", "Amount")], limit=50),
    f"""with {PLACED_SQL} select event_id as "Event No", event_day as "Day", amount as "Amount" from lines order by pos limit 50""",
)
REG.add(
    "file_samples",
    lambda s, d: profiling.samples(profiling.value_counts(event_files(s, d), list(PLACED_COLUMNS), F.col(positions.LOAD_ROW))),
    f"with {PLACED_SQL}, {long_sql('lines', PLACED_COLUMNS)} select raw_column_name, sample_values from sampled",
)


@REG.query(
    "guarded_load",
    """with l as (select *, 'first' as load from customer where c_acctbal < 0 union all select *, 'second' from customer where c_acctbal >= 0)
    select 'after first' as state, count(*) as row_count, cast(sum(c_custkey) as bigint) as key_sum from l where load = 'first'
    union all select 'after empty', count(*), cast(sum(c_custkey) as bigint) from l where load = 'first'
    union all select 'after second', count(*), cast(sum(c_custkey) as bigint) from l where load = 'second'""",
)
def guarded_load(spark: SparkSession, sf: str) -> DataFrame:
    """Three loads into one table: rows, none (refused, the table stays), other rows. The table goes afterwards."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    name, states = f"guarded_{uuid.uuid4().hex[:12]}", []
    loads = {"after first": customers.filter("c_acctbal < 0"), "after empty": customers.filter("c_custkey is null"), "after second": customers.filter("c_acctbal >= 0")}
    try:
        for state, rows in loads.items():
            try:
                raw_csv.load_table(rows, name)
            except raw_csv.EmptyLoadError:
                pass
            found = spark.table(name).agg(F.count(F.lit(1)).alias("row_count"), F.sum("c_custkey").alias("key_sum")).first()
            states.append((state, *found))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return inline_rows(spark, ["state", "row_count", "key_sum"], states)


NORMALIZED_SQL = """case when regexp_matches({n}, '^[0-9]') then 'COL_' || {n} else {n} end"""


def normalized_sql(col: str) -> str:
    plain = (
        f"upper(regexp_replace(regexp_replace(regexp_replace({col}, '^\\s+|\\s+$', '', 'g'), "
        "'[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'))"
    )
    return NORMALIZED_SQL.format(n=plain)


REG.add(
    "header_normalize",
    lambda s, d: files.header_names(
        table(s, d, "pages").select("page_id", F.substring_index("url", "/", -1).alias("header"))
    ),
    f"""with h as (select page_id, list_extract(string_split(url, '/'), -1) as header from pages)
    select page_id, header, {normalized_sql('header')} as normalized from h""",
)
REG.add(
    "header_duplicates",
    lambda s, d: files.header_problems(
        table(s, d, "part").select(
            F.col("p_brand").alias("file_name"),
            F.when(F.col("p_type") == "PROMO", F.lit(" -- ")).otherwise(F.col("p_name")).alias("header"),
        )
    ),
    f"""with h as (select p_brand as file_name, case when p_type = 'PROMO' then ' -- ' else p_name end as header from part),
    n as (select file_name, {normalized_sql('header')} as normalized, count(*) as uses from h group by 1, 2)
    select *, case when normalized = '' then 'empty' else 'duplicate' end as problem from n
    where normalized = '' or uses > 1""",
)
REG.add(
    "safe_names",
    lambda s, d: table(s, d, "documents").select(
        "doc_id",
        is_safe_name(F.col("source")).alias("source_safe"),
        is_safe_name(F.element_at(F.split("text", r"[ \n]"), 1)).alias("first_word_safe"),
        is_safe_name(F.col("text")).alias("text_safe"),
    ),
    """select doc_id, regexp_full_match(source, '[A-Za-z_][A-Za-z0-9_]{0,63}') as source_safe,
    regexp_full_match(regexp_split_to_array(text, '[ \\n]')[1], '[A-Za-z_][A-Za-z0-9_]{0,63}') as first_word_safe,
    regexp_full_match(text, '[A-Za-z_][A-Za-z0-9_]{0,63}') as text_safe from documents""",
)
REG.add(
    "drop_blank_rows",
    lambda s, d: raw_csv.drop_blank_rows(
        events_text(s, d).select("pos", "amount", "note"), ["amount", "note"]
    ),
    f"""with {EVENTS_SQL} select pos, amount, note from ev
    where regexp_matches(amount, '\\S') or regexp_matches(note, '\\S')""",
)

# ---- files --------------------------------------------------------------------------------------

LIMIT_MB = 5


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and pages as uploaded files: sources name the type, pages are HTML."""
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"),
                 F.when(F.col("source") == "src1", ".txt").otherwise(".csv")).alias("file_name"),
        F.col("text").alias("body"),
    )
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".CSV")).alias("file_name"),
        F.col("html").alias("body"),
    )
    return docs.unionByName(pages).select(
        "file_name", F.octet_length("body").cast("long").alias("size_bytes"), F.encode("body", "UTF-8").alias("content")
    )


FILES_SQL = """
f as (
  select 'doc' || doc_id || case when source = 'src1' then '.txt' else '.csv' end as file_name, text as body from documents
  union all select 'page' || page_id || '.CSV', html from pages),
p as (
  select file_name, body, strlen(body) as size_bytes, lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) as extension,
    regexp_replace(body, '(^|[,\\r\\n])(?:"[^"]*")+', '\\1' || chr(1), 'g') as masked,
    regexp_extract(body, '^((?:"[^"]*"|[^"\\r\\n])*)', 1) as header_line from f),
h as (
  select *, string_split_regex(masked, '\\r\\n|\\n|\\r') as lines,
    case when header_line = '' then []::varchar[] else regexp_extract_all(',' || header_line, ',((?:"[^"]*")+|[^,]*)', 1) end as cells
  from p),
q as (
  select *, len(cells) as width,
    list_transform(cells, lambda c: case when starts_with(c, '"') then replace(c[2:-2], '""', '"') else c end) as headers,
    list_filter(lines[2:], lambda x: regexp_matches(x, '[^,\\s\\pZ]')) as data_rows from h),
n as (
  select *, list_transform(headers, lambda c: upper(regexp_replace(regexp_replace(c, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'))) as normalized,
    case when extension <> '.csv' then 'wrong_extension' when size_bytes = 0 then 'empty_file'
      when size_bytes > 5 * 1048576 then 'file_too_large' when contains(body, chr(0)) then 'binary_content'
      when regexp_matches(masked, '(^|[,\\r\\n])"|\\x01[^,\\r\\n]|\\r[^\\n]') then 'unreadable_csv'
      when width = 0 then 'no_header' end as stopped from q)"""
REG.add(
    "file_conformance",
    lambda s, d: files.conformance(document_files(s, d), LIMIT_MB),
    f"""with {FILES_SQL}, r as (
      select file_name, stopped as rule from n where stopped is not null
      union all select file_name, 'too_few_columns' from n where stopped is null and width < 2
      union all select file_name, 'blank_header' from n where stopped is null
        and len(list_filter(headers, lambda c: not regexp_matches(c, '[^\\s\\pZ]'))) > 0
      union all select file_name, 'unsafe_header' from n where stopped is null
        and len(list_filter(normalized, lambda c: c = '')) > 0
      union all select file_name, 'duplicate_header' from n where stopped is null
        and len(list_distinct(list_transform(normalized, lambda c: case when regexp_matches(c, '^[0-9]') then 'COL_' || c else c end))) <> width
      union all select file_name, 'no_data_rows' from n where stopped is null and len(data_rows) = 0
      union all select file_name, 'width_mismatch' from n where stopped is null
        and len(list_filter(data_rows, lambda x: len(string_split(x, ',')) <> width)) > 0)
    select r.file_name, rule, case rule when 'width_mismatch' then list_position(list_transform(data_rows, lambda x: len(string_split(x, ',')) <> width), true) end as bad_row,
      case rule when 'wrong_extension' then 'INVALID_FILE_TYPE'
      when 'file_too_large' then 'FILE_TOO_LARGE' else 'INVALID_CSV_FORMAT' end as error_code from r join n on r.file_name = n.file_name""",
)
REG.add(
    "file_manifest",
    lambda s, d: files.manifest(document_files(s, d)),
    f"""with {FILES_SQL} select file_name, extension, size_bytes, round(size_bytes / 1048576, 4) as size_mb,
    sha256(body) as checksum_sha256, len(data_rows) as row_count, width as column_count from n""",
)

# ---- sinks --------------------------------------------------------------------------------------


# For each model a sum over its values, so that wrong contents show as well as missing rows.
MODEL_SUMS = {
    "stg_retail_transactions": "sum(cost)", "int_retail_sales_enriched": "sum(gross_margin)", "fact_sales": "sum(net_revenue)",
    "dim_customer": "sum(length(customer_name) + length(customer_segment))", "dim_product": "sum(length(product_name) + length(product_category))",
    "dim_store": "sum(length(store_name) + length(store_region))", "dim_date": "sum(order_year * 100 + order_month_number)",
    "mart_sales_performance": "sum(revenue) + sum(orders)", "mart_product_performance": "sum(revenue) + sum(quantity)",
    "mart_customer_segments": "sum(revenue) + sum(orders)", "mart_store_performance": "sum(revenue) + sum(orders)",
}
MODEL_TABLES = {"stg_retail_transactions": "stg", "int_retail_sales_enriched": "int", "fact_sales": "int"}


@REG.query(
    "layer_tables",
    f"with {MART_SQL} " + " union all ".join(
        f"select '{name}' as model, '{layer}' as layer, count(*) as row_count, cast({MODEL_SUMS[name]} as double) as value_sum from {MODEL_TABLES.get(name, name)}"
        for layer, names in RetailModel.LAYERS.items() for name in names
    ),
)
def layer_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Writes every layer as a table in the shared folder, then counts and sums what can be read back."""
    model = RetailModel(retail_feed(spark, sf))
    written = model.write(sinks.parquet_writer(scratch_folder(spark, "layers"), {"fact_sales": "order_month"}))
    counts = None
    for layer, names in RetailModel.LAYERS.items():
        for name in names:
            one = written[name].agg(F.count("*").alias("row_count"), F.expr(MODEL_SUMS[name]).cast("double").alias("value_sum")).select(
                F.lit(name).alias("model"), F.lit(layer).alias("layer"), "row_count", "value_sum"
            )
            counts = one if counts is None else counts.unionByName(one)
    return counts


SNAPSHOT_PLAN = AnalysisPlan(
    "mart_sales_performance", (("revenue", "sum"), ("orders", "sum")), ("order_month",),
    sort=(("order_month", "desc"),), limit=500,
)


CHART_PLAN = AnalysisPlan("mart_sales_performance", (("revenue", "sum"),), ("order_month",), sort=(("order_month", "asc"),), limit=500)


@REG.query(
    "plan_chart",
    f"""with {MART_SQL}, r as (select order_month, sum(revenue) as revenue, row_number() over (order by order_month asc nulls last) as pos
      from mart_sales_performance group by 1)
    select 'line' as chart_type, pos - 1 as position, strftime(order_month, '%Y-%m-%d') as x,
      cast(revenue as double) as y from r""",
)
def plan_chart(spark: SparkSession, sf: str) -> DataFrame:
    """From a plan to the points of its chart: run, snapshot, chart choice, series."""
    snapshot = sinks.result_snapshot(run_plan(mart(spark, sf, CHART_PLAN.source_model), CHART_PLAN), CHART_PLAN.limit)
    chosen = charts.choose(sinks.as_chart_result(snapshot, CHART_PLAN, "How did revenue develop?"))
    return charts.series(chosen).select("chart_type", F.col("position").cast("long").alias("position"), "x", "y")


@REG.query(
    "result_snapshot",
    f"""with {MART_SQL}, r as (select order_month, sum(revenue) as revenue, cast(sum(orders) as bigint) as orders,
      row_number() over (order by order_month desc nulls first) as pos from mart_sales_performance group by 1)
    select pos - 1 as row_position, strftime(order_month, '%Y-%m-%d') as order_month, cast(revenue as double) as revenue,
      orders, (select count(*) from r where pos <= 12) as row_count, 'order_month|revenue|orders' as field_names
    from r where pos <= 12""",
)
def result_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot document of one plan, unfolded to one line per preview row."""
    snapshot = sinks.result_snapshot(run_plan(mart(spark, sf, SNAPSHOT_PLAN.source_model), SNAPSHOT_PLAN), 12)
    return snapshot.select(
        "row_count",
        F.array_join(F.transform("output_schema", lambda f: f["name"]), "|").alias("field_names"),
        F.posexplode("preview_rows").alias("row_position", "row"),
    ).select("row_position", "row.order_month", "row.revenue", "row.orders", "row_count", "field_names")
