"""Plan checks, charts, text rules and screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.functions import cleaning as C
from martloom.functions import text as X
from martloom.operators import charts as G
from martloom.operators import plan_checks as Q
from martloom.operators import proposals as P
from martloom.operators import redaction
from martloom.operators import screening as Z
from martloom.plans import batch as B
from martloom.plans.retail import RETAIL_CATALOG
from martloom.operators.proposals import BASE_TERMS
from martloom.registry.common import Registry
from martloom.registry.modelling import ACCEPTED_SQL
from martloom.registry.modelling import accepted as accepted_specs
from martloom.registry.retail import MART_SQL, marts
from martloom.registry.workspace import NORMALIZED
from martloom.sources import payloads as Y
from martloom.sources.feeds import table
from martloom.sources.inline import catalog

REG = Registry()

# ---- plans --------------------------------------------------------------------------------------

CATALOG_SQL = "catalog(mart, grain, metrics, dimensions) as (values " + ", ".join(
    f"('{n}', '{m['grain']}', {m['metrics']!r}, {m['dimensions']!r})" for n, m in RETAIL_CATALOG.items()
) + ")"
PLAN_RULES = (
    "secret_text", "not_json_object", "contains_sql", "decision_type", "needs_confirmation", "unknown_model", "metrics_required", "metric_name",
    "metric_aggregation", "dimensions_list", "dimension_name", "filters_list", "filter_field", "filter_operator", "filter_value",
    "sort_list", "sort_field", "sort_direction", "limit_integer", "limit_range", "question_text", "intent_name", "grain_text",
    "sort_not_selected", "metric_repeated",
)
PLANS_SQL = f"""{CATALOG_SQL},
p as (select o_orderkey as plan_id, {Y.PLAN_PAYLOAD} as payload from orders),
g as (select *, case when contains(lower(payload), 'api_key') or contains(lower(payload), 'secret') then 'secret_text'
  when not json_valid(payload) then 'not_json_object' when json_type(payload) <> 'OBJECT' then 'not_json_object' end as stop from p),
j as (select plan_id, payload as j, nullif(trim(json_extract_string(payload, '$.decision_type')), '') as decision,
    json_extract_string(payload, '$.source_model') as model, coalesce(json_array_length(payload, '$.metrics'), 0) as n_metrics,
    json_type(payload, '$.limit') as limit_type, json_type(payload, '$.dimensions') as dimensions_type,
    nullif(trim(json_extract_string(payload, '$.question')), '') as question, json_extract_string(payload, '$.intent') as intent,
    json_extract_string(payload, '$.metrics[*].name') as names,
    list_transform(json_extract_string(payload, '$.metrics[*].aggregation'), lambda a: lower(trim(a))) as aggs,
    case when json_type(payload, '$.dimensions') = 'ARRAY' then list_distinct(json_extract_string(payload, '$.dimensions[*]')) else [] end as dims,
    json_extract_string(payload, '$.filters[*].field') as filter_fields, json_extract_string(payload, '$.filters[*].operator') as filter_ops,
    list_transform(json_extract(payload, '$.filters[*].value'), lambda v: json_type(v)) as filter_types,
    json_extract_string(payload, '$.sort[*].field') as sort_fields,
    list_transform(json_extract_string(payload, '$.sort[*].direction'), lambda a: lower(a)) as sort_dirs
  from g where stop is null),
c as (select j.*, grain, metrics, dimensions, mart is not null as known from j left join catalog on model = mart),
violations(plan_id, rule) as (
  select plan_id, stop from g where stop is not null
  union all select plan_id, 'contains_sql' from c where json_exists(j, '$.sql') or json_exists(j, '$.generated_sql')
  union all select plan_id, 'decision_type' from c where coalesce(decision not in ('create_new', 'needs_user_confirmation'), true)
  union all select plan_id, 'needs_confirmation' from c where decision = 'needs_user_confirmation'
  union all select plan_id, 'unknown_model' from c where not known
  union all select plan_id, 'metrics_required' from c where n_metrics < 1
  union all select plan_id, 'metric_name' from c where known and not list_has_all(metrics, names)
  union all select plan_id, 'metric_aggregation' from c where not list_has_all(['sum', 'avg', 'count', 'min', 'max'], aggs)
  union all select plan_id, 'dimensions_list' from c where dimensions_type <> 'ARRAY'
  union all select plan_id, 'dimension_name' from c where known and not list_has_all(dimensions, dims)
  union all select plan_id, 'filter_field' from c where known and not list_has_all(dimensions, filter_fields)
  union all select plan_id, 'filter_operator' from c where not list_has_all(['=', '!='], filter_ops)
  union all select plan_id, 'filter_value' from c where list_has_any(['OBJECT', 'ARRAY'], filter_types)
  union all select plan_id, 'sort_field' from c where known and not list_has_all(list_concat(dimensions, metrics), sort_fields)
  union all select plan_id, 'sort_direction' from c where not list_has_all(['asc', 'desc'], sort_dirs)
  union all select plan_id, 'limit_integer' from c where limit_type not in ('UBIGINT', 'BIGINT')
  union all select plan_id, 'limit_range' from c where limit_type in ('UBIGINT', 'BIGINT') and cast(json_extract(j, '$.limit') as bigint) not between 1 and 500
  union all select plan_id, 'question_text' from c where question is null
  union all select plan_id, 'intent_name' from c where not regexp_full_match(intent, '[A-Za-z_][A-Za-z0-9_]{{0,63}}')
  union all select plan_id, 'sort_not_selected' from c where known
    and len(list_filter(sort_fields, lambda f: list_contains(list_concat(dimensions, metrics), f) and not list_contains(list_concat(dims, names), f))) > 0
  union all select plan_id, 'metric_repeated' from c where len(list_distinct(names)) < len(names))"""


def plan_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return Y.plans(spark, sf), catalog(spark, RETAIL_CATALOG)


REG.add(
    "plan_violations",
    lambda s, d: Q.violations(*plan_frames(s, d)),
    f"""with {PLANS_SQL} select plan_id, rule,
      row_number() over (partition by plan_id order by list_position({list(PLAN_RULES)!r}, rule)) - 1 as position from violations""",
)
REG.add(
    "plan_accepted",
    lambda s, d: Q.accepted(*plan_frames(s, d)).select(
        "plan_id", "source_model", F.transform("metrics", lambda m: F.concat_ws(":", m["name"], m["aggregation"])).alias("metrics"),
        "dimensions", F.col("row_limit").cast("long").alias("row_limit"), "question", "intent", "result_grain",
        F.transform("filters", lambda f: F.concat_ws(" ", f["field"], f["operator"], f["value"])).alias("filters"),
        F.transform("sort", lambda f: F.concat_ws(" ", f["field"], f["direction"])).alias("sort"),
    ),
    f"""with {PLANS_SQL} select plan_id, model as source_model,
      array_to_string(list_transform(list_zip(names, aggs), lambda z: z[1] || ':' || z[2]), '|') as metrics,
      array_to_string(dims, '|') as dimensions,
      cast(json_extract(j, '$.limit') as bigint) as row_limit, question, intent, grain as result_grain,
      array_to_string(list_transform(list_zip(filter_fields, filter_ops, json_extract(j, '$.filters[*].value')),
        lambda z: z[1] || ' ' || z[2] || ' ' || cast(z[3] as varchar)), '|') as filters,
      array_to_string(list_transform(list_zip(sort_fields, sort_dirs), lambda z: z[1] || ' ' || z[2]), '|') as sort
    from c where plan_id not in (select plan_id from violations)""",
)

CELLS_SQL = " union all ".join(
    f"select '{name}' as model, '{field}' as field, " + (f"strftime({field}, '%Y-%m-%d')" if field == "order_month" else field)
    + f" as member, '{metric}' as metric, cast({metric} as double) as value from {name}"
    for name, m in RETAIL_CATALOG.items() for field in m["dimensions"] for metric in m["metrics"]
)


@REG.query(
    "plan_batch",
    # Payloads group by one dimension and sort by one field; the SQL states just that.
    f"""with {MART_SQL}, cells as ({CELLS_SQL}), {PLANS_SQL},
    good as (select plan_id, model, names, aggs, dims[1] as dim, filter_fields[1] as ff, filter_ops[1] as fo,
        json_extract_string(j, '$.filters[0].value') as fv, sort_fields[1] as sf, sort_dirs[1] as sd, cast(json_extract(j, '$.limit') as bigint) as row_limit
      from c where plan_id not in (select plan_id from violations)),
    want as (select * exclude (names, aggs), unnest(names) as metric, unnest(aggs) as agg from good),
    sums as (select plan_id, dim, case when dim is not null then member end as member, metric, agg, sf, sd, row_limit, sum(value) as total, avg(value) as mean, count(value) as many,
        min(value) as least, max(value) as most from want join cells using (model, metric)
      where cells.field = coalesce(dim, case model when 'mart_sales_performance' then 'order_month' when 'mart_product_performance' then 'product_name'
          when 'mart_customer_segments' then 'customer_segment' else 'store_name' end)
        and (ff is null or coalesce(case when ff = 'order_month' then case fo when '=' then member = strftime(try_cast(fv as date), '%Y-%m-%d') else member <> strftime(try_cast(fv as date), '%Y-%m-%d') end
          else case fo when '=' then member = fv else member <> fv end end, false))
      group by all),
    results as (select *, case agg when 'sum' then total when 'avg' then mean when 'count' then many when 'min' then least else most end as value from sums),
    placed as (select *, max(case when metric = sf then value end) over (partition by plan_id, member) as by_value from results),
    ranked as (select *, dense_rank() over (partition by plan_id order by
        case when sd = 'asc' then by_value end asc nulls last, case when sd = 'desc' then by_value end desc nulls first,
        case when sd = 'desc' and sf = dim then member end desc nulls first, member asc nulls last) - 1 as position from placed)
    select plan_id, cast(position as bigint) as position, coalesce(member, '') as members, metric, value from ranked where position < row_limit""",
)
def plan_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every accepted plan's result: plans are checked once, marts are aggregated once, plans that ask the same are run once."""
    plans = B.kept(B.distinct_plans(Q.accepted(*plan_frames(spark, sf))).select("plan_id", "plan_key", *B.ASKED))
    found = B.run_batch(plans, marts(spark, sf), RETAIL_CATALOG)
    members = F.transform("members", lambda m: F.coalesce(m, F.lit("")))
    return plans.select("plan_id", "plan_key").join(found, "plan_key").select("plan_id", "position", members.alias("members"), "metric", "value")


# ---- text rules ---------------------------------------------------------------------------------

REG.add(
    "normalize_question",
    lambda s, d: table(s, d, "conversations").select(
        "conv_id", "turn", X.normalize_question(F.concat(F.lit("  "), "text", F.lit(" ?! "))).alias("normalized")
    ),
    f"""select conv_id, turn, {NORMALIZED.format(q="'  ' || text || ' ?! '")} as normalized from conversations""",
)
FLAGGED_TEXT = """case lang when 'fr' then concat('API_KEY=1 ', text) when 'de' then concat(text, ' the PassWord is') when 'es'
  then concat(text, ' ToKen') else text end"""
REG.add(
    "secret_flags",
    lambda s, d: table(s, d, "documents").select("doc_id", F.expr(FLAGGED_TEXT).alias("body")).select(
        "doc_id",
        X.contains_any(F.col("body"), X.SECRET_MARKERS).alias("in_charts"),
        X.contains_any(F.col("body"), X.SPEC_SECRET_MARKERS).alias("in_specs"),
        X.contains_any(F.col("body"), X.PLAN_SECRET_MARKERS).alias("in_plans"),
    ),
    f"""with t as (select doc_id, lower({FLAGGED_TEXT}) as body from documents)
    select doc_id, regexp_matches(body, 'api_key|secret|password|token') as in_charts,
      regexp_matches(body, 'api_key|secret|password') as in_specs, regexp_matches(body, 'api_key|secret') as in_plans from t""",
)
REG.add(
    "redact_text",
    lambda s, d: table(s, d, "documents").select(
        "doc_id", X.redact(F.col("text"), ["the ", "", "ent", "Ouréaux"]).alias("redacted")
    ),
    """select doc_id, replace(replace(replace(text, 'the ', '[redacted]'), 'ent', '[redacted]'), 'Ouréaux', '[redacted]')
    as redacted from documents""",
)


@REG.query(
    "redact_from_table",
    # Words of eight letters or more, and openings of benchmark items, are the secrets. Every occurrence is found, then overlaps are one.
    """with s as (select distinct unnest(list_concat(list_filter(string_split(text, ' '), lambda w: length(w) >= 8), [array_to_string(string_split(text, ' ')[1:3], ' ')])) as secret from benchmark),
    hits as (select doc_id, text, secret, unnest(list_filter(range(1, length(text) - length(secret) + 2), lambda i: substr(text, i, length(secret)) = secret)) as a
      from documents join s on contains(text, secret)),
    spans as (select doc_id, a, max(a + length(secret)) as b from hits group by 1, 2),
    edges as (select *, coalesce(max(b) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding) <= a, true) as fresh from spans),
    islands as (select *, sum(cast(fresh as int)) over (partition by doc_id order by a) as island from edges),
    merged as (select doc_id, island, min(a) as a, max(b) as b from islands group by 1, 2),
    pieces as (select m.doc_id, m.a, substr(text, coalesce(lag(b) over w, 1), m.a - coalesce(lag(b) over w, 1)) || '[redacted]' as piece, b, text from merged m join documents d on m.doc_id = d.doc_id
      window w as (partition by m.doc_id order by a)),
    done as (select doc_id, string_agg(piece, '' order by a) || substr(any_value(text), max(b)) as redacted, count(*) as n from pieces group by 1)
    select d.doc_id, coalesce(redacted, text) as redacted from documents d left join done using (doc_id)""",
)
def redact_from_table(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the secrets that a table holds: long words and openings of benchmark items."""
    words = F.split("text", " ")
    listed = F.concat(F.filter(words, lambda w: F.length(w) >= 8), F.array(F.array_join(F.slice(words, 1, 3), " ")))
    secrets = table(spark, sf, "benchmark").select(F.explode(listed).alias("secret"))
    return redaction.redact(table(spark, sf, "documents").select("doc_id", F.col("text").alias("redacted")), "doc_id", "redacted", secrets)


DISPLAY = """case l_returnflag when 'R' then concat('1,', cast(cast(l_extendedprice as decimal(18,2)) as {text}))
  when 'A' then ' ' else concat(cast(l_linenumber as {text}), ' pcs') end"""
REG.add(
    "numeric_coerce",
    lambda s, d: table(s, d, "lineitem")
    .select("l_orderkey", F.expr(DISPLAY.format(text="string")).alias("shown"))
    .select("l_orderkey", "shown", C.to_number(F.col("shown")).alias("number"), C.is_number_text(F.col("shown")).alias("is_number")),
    f"""with t as (select l_orderkey, {DISPLAY.format(text='varchar')} as shown from lineitem)
    select l_orderkey, shown, case when trim(shown) = '' then 0.0 else try_cast(replace(shown, ',', '') as double) end as number,
      trim(shown) <> '' and try_cast(replace(shown, ',', '') as double) is not null as is_number from t""",
)
FIELD_NAME = "concat(replace(p_name, ' ', '_'), '__', lower(p_type), case when p_size > 30 then '_REVENUE' when p_size > 20 then '_rate' else '' end)"
REG.add(
    "humanize",
    lambda s, d: table(s, d, "part").select("p_partkey", C.humanize(F.expr(FIELD_NAME)).alias("label")),
    f"""select p_partkey, array_to_string(list_transform(string_split_regex(trim(regexp_replace({FIELD_NAME}, '[_\\s]+', ' ', 'g')), ' '),
      lambda w: upper(w[1]) || lower(w[2:])), ' ') as label from part""",
)
REG.add(
    "format_hint",
    lambda s, d: table(s, d, "part").select(
        "p_partkey", F.coalesce(C.format_hint(F.expr(FIELD_NAME)), F.lit("none")).alias("format")
    ),
    f"""select p_partkey, case when regexp_matches(lower({FIELD_NAME}), 'revenue|margin|cost|sales|amount') then 'currency'
      when regexp_matches(lower({FIELD_NAME}), 'rate|percent|ratio') then 'percent' else 'none' end as format from part""",
)

# ---- charts -------------------------------------------------------------------------------------

RESULT_COLUMNS = (
    "o_orderkey as run_id",
    "case o_orderkey % 3 when 0 then 'revenue' when 1 then 'orders' else 'label' end as metric",
    "case o_custkey % 4 when 1 then 'order_month' when 2 then 'product_category' when 3 then 'store_rank' end as dim",
    "case when o_orderkey % 5 = 0 or o_orderkey % 3 = 2 then 'TEXT' else 'NUMBER(18,2)' end as metric_type",
    "case when o_custkey % 4 = 3 and o_orderkey % 7 = 0 then 'FIXED' when o_orderkey % 11 = 0 then 'DATE' else 'TEXT' end as dim_type",
    """case when o_orderkey % 3 = 2 then 'n/a' else concat('1,', cast(cast(o_totalprice as decimal(18,2)) as {text})) end as value""",
    "o_orderpriority as label", "o_orderkey % 4 as extra_rows",
    "case o_orderpriority when '1-URGENT' then 'Top stores' when '2-HIGH' then 'What sold' else 'Best months?' end as question",
    "case when o_orderstatus = 'P' then 'ranking' end as intent",
    "case when o_orderkey % 13 = 0 then 'mart_other' else 'mart_sales' end as source_model",
    """case o_orderkey % 17 when 0 then 'pie' when 1 then 'line' when 2 then 'table' when 3 then 'horizontal_bar' when 4 then 'kpi'
    else 'bar' end as asked_type""",
)
FLAT_SQL = "flat as (select " + ", ".join(RESULT_COLUMNS).format(text="varchar") + """ from orders),
r as (select *, metric_type = 'NUMBER(18,2)' or value <> 'n/a' as metric_numeric, dim_type = 'FIXED' as dim_numeric,
    dim_type = 'DATE' or dim = 'order_month' as dim_time, 1 + extra_rows as n_rows from flat),
chart as (select *, case when n_rows = 1 and metric_numeric and dim is null then 'kpi'
    when metric_numeric and dim is not null and dim_time then 'line'
    when metric_numeric and dim is not null and regexp_matches(lower(question || ' ' || coalesce(intent, '')), 'top|rank|ranking|highest|best|lowest') then 'horizontal_bar'
    when metric_numeric and dim is not null then 'bar' else 'table' end as chart_type from r)"""
LABEL = """array_to_string(list_transform(string_split({c}, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Stored results, one per order: schema, a few preview rows, and what the run asked for."""
    flat = table(spark, sf, "orders").selectExpr(*(c.format(text="string") for c in RESULT_COLUMNS))
    dim, metric = F.upper("dim"), F.upper("metric")
    fields = F.array_compact(
        F.array(
            F.when(F.col("dim").isNotNull(), F.struct(dim.alias("name"), F.col("dim_type").alias("type"))),
            F.struct(metric.alias("name"), F.col("metric_type").alias("type")),
        )
    )
    row = F.when(F.col("dim").isNull(), F.create_map(metric, "value")).otherwise(
        F.create_map(dim, "label", metric, "value")
    )
    return flat.select(
        "run_id", "question", "intent", "source_model", F.lit("one row per group").alias("grain"), "asked_type",
        F.array("metric").alias("metrics"), F.array_compact(F.array(F.lit(None).cast("string"), "dim")).alias("dimensions"),
        fields.alias("output_schema"), F.array_repeat(row, (F.col("extra_rows") + 1).cast("int")).alias("preview_rows"),
    )


REG.add(
    "chart_type",
    lambda s, d: G.choose(results(s, d)).select("run_id", "chart_type", "title"),
    f"""with {FLAT_SQL} select run_id, chart_type, case chart_type when 'kpi' then {LABEL.format(c='metric')}
      when 'line' then {LABEL.format(c='metric')} || ' Trend' when 'table' then 'Analysis Result'
      else {LABEL.format(c='metric')} || ' by ' || {LABEL.format(c='dim')} end as title from chart""",
)
REG.add(
    "chart_field_kinds",
    lambda s, d: G.field_kinds(results(s, d)),
    f"""with {FLAT_SQL} select run_id, upper(metric) as field, metric_numeric as is_numeric, false as is_time from r
    union all select run_id, upper(dim), dim_numeric, dim_time from r where dim is not null""",
)
PART = lambda path: F.get_json_object("chart_spec", path)
REG.add(
    "chart_spec",
    lambda s, d: G.choose(results(s, d)).select(
        "run_id", PART("$.type").alias("type"), PART("$.title").alias("title"), PART("$.x.field").alias("x_field"),
        PART("$.x.semantic_type").alias("x_type"), PART("$.y.label").alias("y_label"), PART("$.y.format").alias("y_format"),
        PART("$.value.field").alias("value_field"), PART("$.columns[0].label").alias("first_column"),
        PART("$.source_model").alias("source_model"), PART("$.tags[0]").alias("tag"),
    ),
    f"""with {FLAT_SQL} select run_id, chart_type as type, case chart_type when 'kpi' then {LABEL.format(c='metric')}
      when 'line' then {LABEL.format(c='metric')} || ' Trend' when 'table' then 'Analysis Result'
      else {LABEL.format(c='metric')} || ' by ' || {LABEL.format(c='dim')} end as title,
      case when chart_type in ('line', 'bar', 'horizontal_bar') then upper(dim) end as x_field,
      case chart_type when 'line' then 'time' when 'bar' then 'category' when 'horizontal_bar' then 'category' end as x_type,
      case when chart_type in ('line', 'bar', 'horizontal_bar') then {LABEL.format(c='metric')} end as y_label,
      case when chart_type in ('line', 'bar', 'horizontal_bar') and metric = 'revenue' then 'currency' end as y_format,
      case when chart_type = 'kpi' then upper(metric) end as value_field,
      case when chart_type = 'table' then coalesce({LABEL.format(c='dim')}, {LABEL.format(c='metric')}) end as first_column,
      source_model, case chart_type when 'kpi' then metric when 'table' then 'table' when 'line' then 'trend' else 'breakdown' end as tag
    from chart""",
)
ASKED_SPEC = """concat('{"type": "', asked_type, '", "source_model": "mart_sales", "value": {"field": "', upper(metrics[0]),
  '"}, "x": {"field": "', case when run_id % 19 = 0 then 'NO_FIELD' else upper(coalesce(get(dimensions, 0), 'STORE_RANK')) end,
  '"}, "y": {"field": "', upper(metrics[0]), '"}, "columns": [{"field": "', upper(metrics[0]), '"}]',
  case when run_id % 23 = 0 then ', "layout": "plotly"' when run_id % 23 = 1 then ', "note": "token"' else '' end, '}')"""
REG.add(
    "chart_violations",
    lambda s, d: G.violations(results(s, d).withColumn("chart_spec", F.expr(ASKED_SPEC))),
    f"""with {FLAT_SQL}, a as (select *, case when run_id % 19 = 0 then 'NO_FIELD' else upper(coalesce(dim, 'STORE_RANK')) end as x,
      asked_type in ('bar', 'horizontal_bar', 'line') as axes from r),
    b as (select *, x = upper(dim) as x_known from a),
    found as (select run_id, 'unsupported_type' as rule from b where asked_type = 'pie'
    union all select run_id, 'plotly_config' from b where run_id % 23 = 0
    union all select run_id, 'unknown_source_model' from b where source_model <> 'mart_sales'
    union all select run_id, 'secret_text' from b where run_id % 23 = 1
    union all select run_id, 'fields_outside_schema' from b where axes and not coalesce(x_known, false)
    union all select run_id, 'kpi_not_numeric' from b where asked_type = 'kpi' and not metric_numeric
    union all select run_id, 'y_not_numeric' from b where axes and not metric_numeric
    union all select run_id, 'line_x_not_time' from b where asked_type = 'line' and not (coalesce(x_known, false) and dim_time)
    union all select run_id, 'bar_x_numeric' from b where asked_type in ('bar', 'horizontal_bar') and coalesce(x_known, false) and dim_numeric)
    select run_id, rule, row_number() over (partition by run_id order by list_position(['unsupported_type', 'plotly_config', 'unknown_source_model',
      'secret_text', 'fields_outside_schema', 'kpi_not_numeric', 'y_not_numeric', 'line_x_not_time', 'bar_x_numeric'], rule)) - 1 as position from found""",
)
REG.add(
    "chart_series",
    lambda s, d: G.series(G.choose(results(s, d)), compact=True),
    f"""with {FLAT_SQL}, n as (select *, unnest(range(cast(n_rows as bigint))) as position from chart)
    select run_id, chart_type, position, case when dim is not null and (metric_numeric or chart_type = 'table') then label end as x,
      case when metric_numeric then try_cast(replace(value, ',', '') as double) end as y,
      case when metric_numeric then value end as y_text, chart_type <> 'table' or position < 3 as within_limit from n""",
)

# ---- screens ------------------------------------------------------------------------------------

TERMS = Z.terms_of(RETAIL_CATALOG)


def question_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One payload per turn: two near-equal questions, then the turn's sentences as questions.

    On some turns the first question has a bad intent, so that its second spelling is the first good one; on others
    intents are no text.
    """
    ending = F.when(F.col("role") == "user", " by region?").when(F.col("role") == "assistant", "?").otherwise("")
    intent = F.when(F.col("turn") % 3 == 0, F.lit("two words")).when(F.col("turn") % 3 == 1, F.lit("trend"))
    asked = F.concat(
        F.array(F.lit("Revenue by  month?"), F.lit("revenue BY month? ")),
        F.transform(F.split("text", r"\."), lambda t: F.concat(t, ending)),
    )
    first = F.when(F.col("conv_id") % 5 == 2, F.lit("not safe"))
    items = F.transform(
        asked, lambda q, i: F.struct(q.alias("question"), F.when(i > 1, intent).when(i == 0, first).alias("intent"))
    )
    payload = F.to_json(F.struct(items.alias("suggested_questions")))
    untyped = F.replace(payload, F.lit('"intent":"trend"'), F.lit('"intent":true'))
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("payload_id"),
        F.when(F.col("conv_id") % 7 == 3, untyped).otherwise(payload).alias("payload"),
    )


CLEAN = "trim(regexp_replace({c}, '[\\s\\pZ]+', ' ', 'g'))"
def question_screen_sql(terms: str, has_term: str, more: str = "") -> str:
    return f"""with {more}a as (select conv_id || '-' || turn as payload_id, conv_id, text, case turn % 3 when 0 then 'two words' when 1 then 'trend' end as intent,
      list_concat(['Revenue by  month?', 'revenue BY month? '], list_transform(string_split(text, '.'),
        lambda t: t || case role when 'user' then ' by region?' when 'assistant' then '?' else '' end)) as asked from conversations),
    q as (select payload_id, conv_id, text, case when position > 1 then intent when position = 0 and conv_id % 5 = 2 then 'not safe' end as intent,
        conv_id % 7 = 3 and intent = 'trend' and position > 1 as untyped, position, {CLEAN.format(c='question')} as question from (
      select payload_id, conv_id, text, intent, unnest(asked) as question, generate_subscripts(asked, 1) - 1 as position from a)),
    v as (select *, concat_ws('|', case when length(question) < 1 or length(question) > 180 then 'text' end,
        case when not contains(question, '?') then 'no_question_mark' end,
        case when regexp_matches(lower(question), '{'|'.join(Z.RAW_ONLY_TERMS)}') then 'raw_only_term' end,
        case when not {has_term} then 'no_catalog_term' end,
        case when regexp_matches(lower(question), '(dashboard|chart|insight).{{0,40}}(ready|created|generated)') then 'claims_ready' end,
        case when untyped or not regexp_full_match(intent, '[A-Za-z_][A-Za-z0-9_]{{0,63}}') then 'intent' end) as violations from q {terms}),
    firsts as (select payload_id, lower(question) as key, min(position) as position from v where violations = '' group by 1, 2),
    s as (select conv_id || '-' || turn as payload_id from conversations where regexp_matches(lower(text), 'api_key|secret'))
    select payload_id, position, question, violations, (payload_id, lower(question), position) in (select (payload_id, key, position) from firsts) as kept,
      position < 5 as within_limit
    from v where payload_id not in (select payload_id from s)
    union all select payload_id, -1, null, 'secret_text', false, true from s"""


REG.add(
    "question_screen",
    lambda s, d: Z.screen_questions(question_payloads(s, d), TERMS),
    question_screen_sql("", f"regexp_matches(lower(question), '{'|'.join(TERMS)}')"),
)


@REG.query(
    "question_screen_by_dataset",
    question_screen_sql(
        "left join own on conv_id + 1 = proposal_id",
        f"case when own.words is null then regexp_matches(lower(question), '{'|'.join(TERMS)}') else len(list_filter(own.words, lambda t: contains(lower(question), t))) > 0 end",
        f"""{ACCEPTED_SQL}, fields as (select proposal_id, lower(unnest(list_concat(dimensions, metrics))) as field from good_marts),
      words as (select proposal_id, unnest({list(BASE_TERMS)!r}) as term from good union select proposal_id, lower(name) from good_marts
        union select * from fields union select proposal_id, part from (select proposal_id, unnest(string_split(field, '_')) as part from fields) where part <> ''),
      own as (select proposal_id, list(term) as words from words group by 1), """,
    ),
)
def question_screen_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Questions judged by the marts of their own dataset's accepted proposal, or by the retail catalog where it has none."""
    terms = P.catalog_terms(P.catalog(accepted_specs(spark, sf)), ["proposal_id"]).withColumnRenamed("proposal_id", "dataset_id")
    payloads = question_payloads(spark, sf).withColumn("dataset_id", F.split("payload_id", "-")[0].cast("long") + 1)
    return Z.screen_questions(payloads, TERMS, terms, ["dataset_id"])


REG.add(
    "dedupe_questions",
    lambda s, d: Z.first_of_each(
        table(s, d, "documents")
        .select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "question"))
        .withColumn("question", F.when(F.col("doc_id") % 2 == 0, F.replace("question", F.lit("e"), F.lit("E"))).otherwise(F.col("question"))),
        ["source"], ["doc_id", "line_no"], "question",
    ),
    """with l as (select source, doc_id, unnest(string_split(text, chr(10))) as question,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
      u as (select source, doc_id, line_no, case when doc_id % 2 = 0 then replace(question, 'e', 'E') else question end as question from l)
    select source, doc_id, line_no, question from u
    qualify row_number() over (partition by source, lower(question) order by doc_id, line_no) = 1""",
)


def insight_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One payload per document: its text as the summary, its lines as findings and as chart insights of their own, and an empty one.

    Some documents hold numbers, texts and lists in the wrong places.
    """
    lines = F.split("text", "\n")
    title = (
        F.when(F.col("doc_id") % 3 == 0, "revenue trend").when(F.col("doc_id") % 3 == 1, "Margin by Store").otherwise("")
    )
    question = F.struct(
        F.when(F.col("doc_id") % 10 == 0, F.lit("This proves that all  customers pay")).otherwise(F.col("text")).alias("summary"),
        lines.alias("key_findings"),
        F.array(F.lit("Trend"), F.lit("data quality"), F.when(F.col("lang") == "fr", "mood").otherwise("trend")).alias("tags"),
        F.when(F.col("lang") == "en", "High").when(F.col("lang") == "de", "low").otherwise("sure").alias("confidence"),
    )
    chart = lambda line: F.struct(
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("chart-"), F.col("doc_id").cast("string"))).alias("chart_id"),
        title.alias("chart_title"), line.alias("summary"), F.array(F.lit("store")).alias("tags"), F.lit("medium").alias("confidence"),
    )
    last = F.struct(
        F.lit(None).cast("string").alias("chart_id"), F.lit("Revenue Trend").alias("chart_title"), F.lit("").alias("summary"),
        F.array(F.lit("store")).alias("tags"), F.lit("medium").alias("confidence"),
    )
    charted = F.concat(F.transform(lines, chart), F.array(last)).alias("chart_insights")
    payload = F.to_json(F.struct(question.alias("question_insight"), charted))
    wrong = F.lit('{"question_insight":{"summary":5,"key_findings":"all customers","tags":"trend","confidence":["low"]},"chart_insights":[7]}')
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("run_id"), F.when(F.col("doc_id") % 11 == 4, wrong).otherwise(payload).alias("payload")
    )


def label_charts(spark: SparkSession, sf: str) -> DataFrame:
    """Two charts per labelled document; where they share a title, it means the second."""
    title = F.when(F.col("quality") == 1, "Revenue Trend").otherwise("Margin by Store")
    labels = table(spark, sf, "labels")
    first = labels.select(
        F.col("doc_id").alias("run_id"), F.concat(F.lit("chart-"), F.col("doc_id").cast("string")).alias("chart_id"),
        title.alias("title"), F.lit(1).alias("sort_order"),
    )
    second = labels.select(
        F.col("doc_id").alias("run_id"), F.concat(F.lit("a-chart-"), F.col("doc_id").cast("string")).alias("chart_id"),
        F.when(F.col("doc_id") % 2 == 0, title).otherwise(F.lit("Other")).alias("title"), F.lit(2).alias("sort_order"),
    )
    return first.unionByName(second)


CLAIMS_RE = "|".join(Z.UNSUPPORTED_CLAIMS)
BAD_FINDING = f"(length({CLEAN.format(c='f')}) not between 1 and 240 or regexp_matches(lower({CLEAN.format(c='f')}), '{CLAIMS_RE}'))"
REG.add(
    "insight_screen",
    lambda s, d: Z.screen_insights(insight_payloads(s, d), label_charts(s, d)),
    f"""with t as (select doc_id as run_id, string_split(text, chr(10)) as lines, lang,
        case when doc_id % 10 = 0 then 'This proves that all  customers pay' else text end as body, text, doc_id % 11 = 4 as wrong,
        case when doc_id % 5 = 0 then 'chart-' || doc_id when doc_id % 3 = 0 then 'revenue trend' when doc_id % 3 = 1 then 'Margin by Store' end as reference
      from documents),
    titles as (select doc_id, case quality when 1 then 'Revenue Trend' else 'Margin by Store' end as title from labels),
    charts as (select doc_id, 'chart-' || doc_id as chart_id, title, 1 as sort_order from titles
      union all select doc_id, 'a-chart-' || doc_id, case when doc_id % 2 = 0 then title else 'Other' end, 2 from titles),
    named as (select doc_id, lower(title) as reference, arg_max(chart_id, sort_order) as chart_id from charts group by 1, 2
      union all select doc_id, chart_id, chart_id from charts),
    s as (select run_id from t where not wrong and regexp_matches(lower(text), 'api_key|secret|password|token')),
    q as (select run_id, 0 as position, 'question' as insight_level, concat_ws('|',
        case when length({CLEAN.format(c='body')}) not between 1 and 800 then 'summary_text' end,
        case when regexp_matches(lower({CLEAN.format(c='body')}), '{CLAIMS_RE}') then 'summary_claim' end,
        case when len(list_filter(lines, lambda f: length({CLEAN.format(c='f')}) not between 1 and 240)) > 0 then 'finding_text' end,
        case when len(list_filter(lines, lambda f: regexp_matches(lower({CLEAN.format(c='f')}), '{CLAIMS_RE}'))) > 0 then 'finding_claim' end,
        case when lang = 'fr' then 'tag' end, case when lang not in ('en', 'de') then 'confidence' end) as violations,
      case when lang = 'fr' then 'trend|data_quality|mood' else 'trend|data_quality' end as tags,
      case lang when 'en' then 'high' when 'de' then 'low' else 'sure' end as confidence, null as chart_id,
      case when len(list_filter(lines, lambda f: {BAD_FINDING})) = 0 then false
        else len(list_filter(lines[1:5], lambda f: {BAD_FINDING})) > 0 end as finding_within_limit from t where not wrong),
    i as (select run_id, lines, unnest(range(1, len(lines) + 2)) as position, reference from t where not wrong),
    r as (select run_id, lines, position, case when position > len(lines) then 'Revenue Trend' else reference end as reference,
      case when position > len(lines) then '' else lines[position] end as summary from i),
    c as (select r.*, c.chart_id from r left join named c on r.run_id = c.doc_id and (r.reference = c.reference or lower(r.reference) = c.reference)),
    k as (select run_id, position, 'chart' as insight_level, concat_ws('|', case when reference is null then 'no_chart_reference' end,
        case when reference is not null and chart_id is null then 'unknown_chart' end,
        case when length({CLEAN.format(c='summary')}) not between 1 and 800 then 'summary_text' end,
        case when regexp_matches(lower({CLEAN.format(c='summary')}), '{CLAIMS_RE}') then 'summary_claim' end) as violations,
      'store' as tags, 'medium' as confidence, chart_id, false as finding_within_limit from c),
    w as (select run_id, 0 as position, 'question' as insight_level, 'summary_text|findings_list|tags_list|confidence' as violations from t where wrong
      union all select run_id, 1, 'chart', 'insight_object|no_chart_reference|summary_text|confidence' from t where wrong),
    every as (select * from q union all select * from k union all select *, '', null, null, false from w)
    select run_id, cast(position as bigint) as position, insight_level, violations, tags, confidence, chart_id, position <= 3 as within_limit,
      finding_within_limit
    from every where run_id not in (select run_id from s)
    union all select run_id, -1, null, 'secret_text', '', null, null, true, false from s""",
)
