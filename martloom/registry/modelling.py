"""Mappings and modelling proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.operators import lineage as L
from martloom.operators import mapping as M
from martloom.operators import proposals as P
from martloom.operators.unnest import unbroadcast
from martloom.plans import spec as S
from martloom.registry.common import Registry
from martloom.registry.retail import STG_SQL
from martloom.session import scratch_folder
from martloom.sources import payloads as Y
from martloom.sources.buckets import BucketTable
from martloom.sources.feeds import retail_feed, table

REG = Registry()

SAFE = "regexp_full_match({c}, '[A-Za-z_][A-Za-z0-9_]{{0,63}}')"
EFFECTIVE_SQL = f"""{Y.MAPPINGS_SQL},
named as (select *, coalesce(nullif(approved_name, ''), suggested_name) as name,
  coalesce(nullif(approved_role, ''), semantic_role) as role from mappings where include_in_model),
effective as (select * from named where {SAFE.format(c='name')} and role <> 'unknown')"""
FLAGS_SQL = f"""{EFFECTIVE_SQL},
flagged as (select *, role in ('measure_column', 'metric_candidate') or detected_type in ('integer', 'decimal') as is_measure,
  role = 'date_time' or detected_type = 'date' as is_date,
  role in ('identifier', 'dimension', 'date_time')
    or not (role in ('measure_column', 'metric_candidate') or detected_type in ('integer', 'decimal')) as is_dimension,
  role = 'identifier' or detected_type = 'identifier' as is_identifier from effective)"""


def effective(spark: SparkSession, sf: str) -> DataFrame:
    return M.effective(Y.mappings(spark, sf))


REG.add(
    "effective_mappings",
    lambda s, d: effective(s, d).select("dataset_id", "column_index", "raw_column_name", "name", "role"),
    f"""with {EFFECTIVE_SQL} select dataset_id, cast(column_index as bigint) as column_index, raw_column_name, name, role
    from effective""",
)
REG.add(
    "column_sets",
    lambda s, d: M.column_flags(effective(s, d)).select(
        "dataset_id", "name", "is_measure", "is_date", "is_dimension", "is_identifier"
    ),
    f"with {FLAGS_SQL} select dataset_id, name, is_measure, is_date, is_dimension, is_identifier from flagged",
)
REG.add(
    "type_routing",
    lambda s, d: effective(s, d).select(
        "dataset_id", "name", S.route_kind(F.col("role"), F.col("detected_type")).alias("kind")
    ),
    f"""with {FLAGS_SQL} select dataset_id, name, case when is_measure then 'number' when is_date then 'date'
    else 'text' end as kind from flagged""",
)
REG.add(
    "role_groups",
    lambda s, d: M.role_groups(effective(s, d)),
    f"""with {EFFECTIVE_SQL} select dataset_id, role, string_agg(name, '|' order by column_index) as columns
    from effective group by 1, 2""",
)
REG.add(
    "entity_hints",
    lambda s, d: M.entity_hints(effective(s, d)),
    f"""with {EFFECTIVE_SQL},
    entities as (
      select k.dataset_id, left(k.name, length(k.name) - 3) as hint, string_agg(m.name, '|' order by m.column_index) as columns, count(*) as n
      from effective k join effective m on k.dataset_id = m.dataset_id
        and (m.name = k.name or starts_with(m.name, left(k.name, length(k.name) - 3) || '_'))
      where ends_with(k.name, '_id') group by 1, 2),
    other as (
      select dataset_id, 'transaction_attributes' as hint, string_agg(name, '|' order by column_index) as columns from effective
      where name in ('channel', 'payment_method', 'payment_terms', 'order_priority', 'priority', 'status')
        or ends_with(name, '_status') or ends_with(name, '_type') group by 1
      union all select dataset_id, 'grain_evidence', string_agg(name, '|' order by column_index) from effective
      where name in ('order_id', 'invoice_id', 'transaction_id') or ends_with(name, '_line_id') or ends_with(name, '_item_id') group by 1)
    select dataset_id, hint, columns from entities where n > 1 union all select * from other""",
)
SEEN_ROLE = """case when c_mktsegment = 'AUTOMOBILE' then 'dimension' when c_mktsegment = 'FURNITURE' then 'measure_column' else role end"""
REG.add(
    "transformable_datasets",
    lambda s, d: S.transformable(
        # Datasets in review have no measures yet, and those in furniture nothing else.
        unbroadcast(effective(s, d)).join(
            table(s, d, "customer").select(F.col("c_custkey").alias("dataset_id"), "c_mktsegment"), "dataset_id"
        ).withColumn("role", F.expr(SEEN_ROLE))
    ),
    f"""with {EFFECTIVE_SQL}, seen as (select dataset_id, {SEEN_ROLE} as role from effective join customer on dataset_id = c_custkey)
    select dataset_id, bool_or(role in ('measure_column', 'metric_candidate'))
      and bool_or(role in ('dimension', 'date_time', 'identifier')) as transformable from seen group by 1""",
)
UPSERT_SQL = f"""with {Y.MAPPINGS_SQL}, known as (select * from mappings),
    edits as (select {', '.join(Y.EDIT_COLUMNS)} from customer),
    cleaned as (select dataset_id, column_index, trim(approved_name) as new_name, trim(approved_role) as new_role,
      include_in_model as new_include, true as edited from edits),
    ok as (select * from cleaned where {SAFE.format(c='new_name')} and new_role in
      ('identifier', 'date_time', 'measure_column', 'metric_candidate', 'dimension', 'unknown'))
    select coalesce(k.dataset_id, o.dataset_id) as dataset_id, cast(coalesce(k.column_index, o.column_index) as bigint) as column_index,
      coalesce(suggested_name, new_name) as suggested_name, coalesce(semantic_role, new_role) as semantic_role,
      cast(coalesce(confidence, 0) as double) as confidence,
      case when edited then new_name else approved_name end as approved_name,
      case when edited then new_role else approved_role end as approved_role,
      case when edited then new_include else include_in_model end as include_in_model,
      coalesce(edited, false) as user_edited
    from known k full join ok o on k.dataset_id = o.dataset_id and k.column_index = o.column_index"""
REG.add(
    "mapping_upsert",
    lambda s, d: M.apply_edits(
        # Some edits name columns past the last suggestion, which they create.
        Y.mappings(s, d),
        table(s, d, "customer").selectExpr(*Y.EDIT_COLUMNS),
    ),
    UPSERT_SQL,
)


@REG.query("mapping_upsert_written", UPSERT_SQL)
def mapping_upsert_written(spark: SparkSession, sf: str) -> DataFrame:
    """The same edits on a written table: those of some nations, of the others, and of the first ones again. Each time only the touched buckets are rewritten."""
    edits = table(spark, sf, "customer").selectExpr("c_nationkey", *Y.EDIT_COLUMNS)
    none = M.apply_edits(Y.mappings(spark, sf), edits.drop("c_nationkey").limit(0))
    written = BucketTable(spark, scratch_folder(spark, "mappings"), ["dataset_id"], 16).create(none)
    for part in (edits.filter("c_nationkey < 12"), edits.filter("c_nationkey >= 12"), edits.filter("c_nationkey < 12")):
        written.upsert(part.drop("c_nationkey"), M.apply_edits)
    return written.read()


REG.add(
    "mapping_review",
    lambda s, d: M.review_suggestions(
        Y.suggestion_payloads(s, d), Y.mappings(s, d).select("dataset_id", "raw_column_name")
    ),
    f"""with {Y.MAPPINGS_SQL},
    p as (select c_custkey as dataset_id, {Y.SUGGESTION_PAYLOAD} as payload from customer),
    g as (select *, case when contains(lower(payload), 'api_key') or contains(lower(payload), 'secret') then 'secret_text'
      when not json_valid(payload) then 'not_json_object' when coalesce(json_array_length(payload, '$.columns'), 0) < 1 then 'columns_required' end as stop from p),
    i as (select dataset_id, unnest(range(cast(json_array_length(payload, '$.columns') as bigint))) as position, payload from g where stop is null),
    e as (select dataset_id, position, json_extract(payload, '$.columns[' || position || ']') as item from i),
    f as (select dataset_id, position, json_extract_string(item, '$.raw_column_name') as raw_column_name,
      json_extract_string(item, '$.suggested_name') as suggested_name, json_extract_string(item, '$.semantic_role') as semantic_role,
      case when json_type(item, '$.confidence') in ('DOUBLE', 'UBIGINT', 'BIGINT') then cast(json_extract(item, '$.confidence') as double) end as confidence,
      coalesce(cast(json_extract(item, '$.needs_review') as boolean), false) as asked,
      nullif(trim(json_extract_string(item, '$.reason')), '') as reason from e),
    x as (select f.*, row_number() over (partition by dataset_id, raw_column_name order by position) as seen,
      exists (select 1 from contract c where c.raw_column_name = f.raw_column_name) as known from f)
    select dataset_id, position, concat_ws('|', case when not known then 'unknown_column' end,
        case when seen > 1 then 'repeated_column' end, case when not {SAFE.format(c='suggested_name')} then 'unsafe_name' end,
        case when semantic_role not in ('identifier', 'date_time', 'measure_column', 'metric_candidate', 'dimension', 'unknown') then 'unknown_role' end,
        case when confidence is null or confidence < 0 or confidence > 1 then 'bad_confidence' end,
        case when reason is null then 'bad_reason' end) as violations,
      raw_column_name, suggested_name, semantic_role, round(confidence, 4) as confidence,
      asked or coalesce(confidence < 0.75, false) or semantic_role = 'unknown' as needs_review from x
    union all select dataset_id, -1, stop, null, null, null, null, null from g where stop is not null""",
)

# ---- proposals ----------------------------------------------------------------------------------


def sets(spark: SparkSession, sf: str) -> DataFrame:
    return M.column_sets(effective(spark, sf))


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    return P.accepted(Y.proposals(spark, sf), sets(spark, sf))


def _clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _ordered(values: str) -> str:
    """Each value once, where it first stands."""
    return f"list_filter({values}, lambda e, i: list_position({values}, e) = i)"


PARSED_SQL = f"""{FLAGS_SQL},
p as (select c_custkey as proposal_id, {Y.PROPOSAL_PAYLOAD} as payload from customer),
g as (select *, case when contains(lower(payload), 'api_key') or contains(lower(payload), 'secret') or contains(lower(payload), 'password') then 'secret_text'
  when not json_valid(payload) then 'not_json_object' end as stop from p),
j as (select proposal_id, payload as j, nullif({_clean("json_extract_string(payload, '$.grain')")}, '') as grain,
  json_extract_string(payload, '$.fact_table.name') as fact_name,
  json_extract_string(payload, '$.fact_table.keys[*]') as given_keys,
  {_ordered("json_extract_string(payload, '$.fact_table.keys[*]')")} as keys,
  json_extract_string(payload, '$.fact_table.measures[*]') as measures,
  json_extract_string(payload, '$.fact_table.degenerate_dimensions[*]') as degenerate,
  json_extract_string(payload, '$.fact_table.date_columns[*]') as dates from g where stop is null),
dim as (select proposal_id, position, json_extract_string(d, '$.name') as name, json_extract_string(d, '$.key_column') as key_column,
  json_extract_string(d, '$.columns[*]') as given from (
    select proposal_id, unnest(range(cast(json_array_length(j, '$.dimensions') as bigint))) as position, j,
      json_extract(j, '$.dimensions[' || position || ']') as d from j)),
dims as (select proposal_id, position, name, key_column,
  case when list_contains(given, key_column) then given else list_concat([key_column], given) end as columns from dim),
dim_columns as (select proposal_id, position, name, key_column, unnest(columns) as column_name from dims),
mart as (select proposal_id, position, json_extract_string(m, '$.name') as name,
  case when json_type(m, '$.grain') is null then 'one row per mart grouping' when json_type(m, '$.grain') = 'VARCHAR'
    then json_extract_string(m, '$.grain') end as grain,
  json_extract_string(m, '$.dimensions[*]') as dimensions, json_extract_string(m, '$.metrics[*]') as metrics from (
    select proposal_id, unnest(range(cast(json_array_length(j, '$.marts') as bigint))) as position, j,
      json_extract(j, '$.marts[' || position || ']') as m from j)),
mart_dims as (select proposal_id, position, name, unnest(dimensions) as field from mart),
candidates as (
  select proposal_id, unnest(keys) as field from j union select proposal_id, unnest(degenerate) from j
  union select proposal_id, unnest(dates) from j union select proposal_id, unnest(dates) || '_month' from j
  union select proposal_id, column_name from dim_columns)"""


def _unknown(part: str, name: str, rank: int, first: str = "true") -> str:
    return f"""select proposal_id, 1, 0, {rank}, 'fact_{name}_unknown', '', bool_or({first}) from (select proposal_id, given_keys, unnest({part}) as c from j) x
      where not exists (select 1 from flagged f where f.dataset_id = proposal_id and f.name = c) group by 1"""


def _not_flagged(part: str, rule: str, rank: int, flag: str) -> str:
    return f"""select distinct proposal_id, 1, 0, {rank}, '{rule}', '', true from (select proposal_id, unnest({part}) as c from j) x
      where not exists (select 1 from flagged f where f.dataset_id = proposal_id and f.name = c and {flag})"""


# Block, entry and rank give the checking order; the limits are six dimensions, four marts and six keys.
VIOLATIONS_SQL = f"""{PARSED_SQL},
found(proposal_id, block, entry, rank, rule, subject, within_limit) as (
  select proposal_id, 0, 0, 0, stop, '', true from g where stop is not null
  union all select proposal_id, 1, 0, 0, 'grain_text', '', true from j where grain is null
  union all select proposal_id, 1, 0, 3, 'fact_grain', '', true from j where grain is null
  union all select proposal_id, 1, 0, 2, 'fact_name', '', true from j where not regexp_full_match(fact_name, 'fact_[A-Za-z0-9_]*')
  union all select proposal_id, 1, 0, 6, 'fact_degenerate_dimensions_list', '', true from j where json_type(j, '$.fact_table.degenerate_dimensions') <> 'ARRAY'
  union all {_unknown('keys', 'keys', 8, 'list_contains(given_keys[1:6], c)')} union all {_unknown('measures', 'measures', 9)}
  union all {_unknown('degenerate', 'degenerate_dimensions', 10)} union all {_unknown('dates', 'date_columns', 11)}
  union all {_not_flagged('measures', 'fact_measures_numeric', 12, 'is_measure')}
  union all {_not_flagged('degenerate', 'fact_degenerate_labels', 13, 'is_dimension')}
  union all {_not_flagged('dates', 'fact_dates', 14, 'is_date')}
  union all select proposal_id, 2, position, 0, 'dimension_name', name, position < 6 from dims where not regexp_full_match(name, 'dim_[A-Za-z0-9_]*')
  union all select proposal_id, 2, position, 1, 'dimension_repeated', name, position < 6 from dims d where exists (
    select 1 from dims o where o.proposal_id = d.proposal_id and o.name = d.name and o.position < d.position)
  union all select proposal_id, 2, position, 4, 'dimension_unknown_columns', name, position < 6 from (select distinct proposal_id, position, name from dim_columns c
    where not exists (select 1 from flagged f where f.dataset_id = proposal_id and f.name = c.column_name))
  union all select proposal_id, 2, position, 5, 'dimension_holds_measure', name, position < 6 from (select distinct proposal_id, position, name from dim_columns c
    where column_name <> key_column
    and exists (select 1 from flagged f where f.dataset_id = proposal_id and f.name = c.column_name and is_measure))
  union all select proposal_id, 2, position, 6, 'dimension_key_role', name, position < 6 from dims
    where not exists (select 1 from flagged f where f.dataset_id = proposal_id and f.name = key_column and (is_dimension or is_identifier))
  union all select proposal_id, 4, position, 1, 'mart_repeated', name, position < 4 from mart m where exists (
    select 1 from mart o where o.proposal_id = m.proposal_id and o.name = m.name and o.position < m.position)
  union all select proposal_id, 4, position, 2, 'mart_grain', name, position < 4 from mart where grain is null
  union all select proposal_id, 4, position, 5, 'mart_metrics_required', name, position < 4 from mart where len(metrics) = 0
  union all select proposal_id, 4, position, 6, 'mart_unknown_dimension', name, position < 4 from (select distinct proposal_id, position, name from mart_dims m
    where not exists (select 1 from candidates c where c.proposal_id = m.proposal_id and c.field = m.field)
      and not exists (select 1 from flagged f where f.dataset_id = proposal_id and f.name = m.field and is_dimension and not is_measure))
  union all select proposal_id, 4, position, 7, 'mart_metric_not_in_fact', name, position < 4 from (select distinct m.proposal_id, m.position, m.name
    from (select proposal_id, position, name, unnest(metrics) as metric from mart) m join j on m.proposal_id = j.proposal_id
    where not list_contains(j.measures, m.metric))
  union all select proposal_id, 5, 0, 0, 'list_too_long', 'fact_table.keys', false from j where len(given_keys) > 6
  union all select proposal_id, 5, 0, 1, 'list_too_long', 'dimensions', false from dims group by 1 having count(*) > 6
  union all select proposal_id, 5, 0, 2, 'list_too_long', 'marts', false from mart group by 1 having count(*) > 4),
violations as (select proposal_id, row_number() over (partition by proposal_id order by block, entry, rank) - 1 as position, rule, subject, within_limit from found)"""
ACCEPTED_SQL = f"""{VIOLATIONS_SQL},
good as (select * from j where proposal_id not in (select proposal_id from violations)),
good_dims as (select * from dims where proposal_id in (select proposal_id from good)),
good_marts as (select * from mart where proposal_id in (select proposal_id from good))"""

REG.add(
    "proposal_violations",
    lambda s, d: P.violations(Y.proposals(s, d), sets(s, d)),
    f"with {VIOLATIONS_SQL} select * from violations",
)
REG.add(
    "proposal_unknown_columns",
    lambda s, d: P.unknown_columns(P.parse(Y.proposals(s, d)), effective(s, d)),
    f"""with {PARSED_SQL.replace("then 'secret_text'", "then null")}, used as (
      select proposal_id, 'fact_table.keys' as used_in, unnest(keys) as column_name from j
      union all select proposal_id, 'fact_table.measures', unnest(measures) from j
      union all select proposal_id, 'fact_table.degenerate_dimensions', unnest(degenerate) from j
      union all select proposal_id, 'fact_table.date_columns', unnest(dates) from j
      union all select proposal_id, name, column_name from dim_columns)
    select * from used u where not exists (select 1 from effective e where e.dataset_id = u.proposal_id and e.name = u.column_name)""",
)
DERIVED_SQL = f"""{ACCEPTED_SQL},
key_list as (select g.proposal_id, list_concat(keys, list(key_column order by position)) as ks
  from good g join good_dims d on g.proposal_id = d.proposal_id group by g.proposal_id, keys),
inferred as (select m.proposal_id, list(m.field order by m.position, m.ord) as fields from (
    select proposal_id, position, unnest(dimensions) as field, generate_subscripts(dimensions, 1) as ord from good_marts) m
  where not exists (select 1 from candidates c where c.proposal_id = m.proposal_id and c.field = m.field) group by 1)"""
REG.add(
    "proposal_derived",
    lambda s, d: P.derived(accepted(s, d)).drop("fact_columns"),
    f"""with {DERIVED_SQL} select g.proposal_id, array_to_string(ks, '|') as fact_dimension_keys,
      array_to_string(list_concat(degenerate, coalesce(fields, [])), '|') as fact_degenerate_dimensions
    from good g join key_list k on g.proposal_id = k.proposal_id left join inferred i on g.proposal_id = i.proposal_id""",
)
REG.add(
    "fact_columns",
    lambda s, d: P.derived(accepted(s, d)).select("proposal_id", F.posexplode("fact_columns").alias("position", "column_name")),
    f"""with {DERIVED_SQL}, c as (select g.proposal_id, list_concat(keys, ks, degenerate,
        coalesce(fields, []), dates, list_transform(dates, lambda x: x || '_month'), measures) as every
      from good g join key_list k on g.proposal_id = k.proposal_id left join inferred i on g.proposal_id = i.proposal_id),
    o as (select proposal_id, {_ordered('every')} as columns from c)
    select proposal_id, unnest(range(len(columns))) as position, unnest(columns) as column_name from o""",
)
REG.add(
    "mart_catalog",
    lambda s, d: P.catalog(accepted(s, d)),
    f"""with {ACCEPTED_SQL} select proposal_id, name as mart, grain, array_to_string(dimensions, '|') as dimensions,
    array_to_string(metrics, '|') as metrics from good_marts""",
)
REG.add(
    "mart_candidate_fields",
    lambda s, d: P.candidate_fields(accepted(s, d)),
    f"with {ACCEPTED_SQL} select * from candidates where proposal_id in (select proposal_id from good)",
)
REG.add(
    "spec_column_owner",
    lambda s, d: L.column_owners(accepted(s, d)).withColumnRenamed("column", "column_name"),
    f"""with {ACCEPTED_SQL} select proposal_id, column_name, arg_min(name, position) as owner from dim_columns
    where proposal_id in (select proposal_id from good) group by 1, 2""",
)
REG.add(
    "related_dimensions",
    lambda s, d: L.related_dimensions(accepted(s, d)),
    f"""with {ACCEPTED_SQL} select m.proposal_id, m.name as mart,
      coalesce(string_agg(d.name, '|' order by d.position) filter (list_has_any(d.columns, m.dimensions)), '') as related_dimensions
    from good_marts m join good_dims d on m.proposal_id = d.proposal_id group by 1, 2""",
)
REG.add(
    "model_relationships",
    lambda s, d: L.relationships(accepted(s, d)),
    f"""with {ACCEPTED_SQL} select g.proposal_id, fact_name as from_model, name as to_model, 'fact_to_dimension' as relationship_type,
      key_column as join_fields from good g join good_dims d on g.proposal_id = d.proposal_id
    union all select m.proposal_id, m.name, d.name, 'mart_to_dimension',
      array_to_string(list_filter(m.dimensions, lambda f: list_contains(d.columns, f)), '|')
    from good_marts m join good_dims d on m.proposal_id = d.proposal_id where list_has_any(d.columns, m.dimensions)""",
)
TOKENS = """list_distinct(list_filter(string_split(regexp_replace(lower({t}), '[^a-z0-9]+', '_', 'g'), '_'), lambda t: length(t) > 1
  and t not in ('dim', 'fact', 'mart', 'data', 'performance', 'summary', 'analysis', 'analytics', 'total')))"""
REG.add(
    "token_matches",
    lambda s, d: L.matching_dimensions(accepted(s, d)),
    f"""with {ACCEPTED_SQL}, pairs as (
      select m.proposal_id, m.name as mart, d.name as dim, d.position,
        list_has_any(list_concat([d.key_column], d.columns, [d.name]), m.dimensions) as by_field,
        list_has_any({TOKENS.format(t="m.name || '_' || array_to_string(m.dimensions, '_')")},
          {TOKENS.format(t="d.name || '_' || d.key_column || '_' || array_to_string(d.columns, '_')")}) as by_token
      from good_marts m join good_dims d on m.proposal_id = d.proposal_id),
    best as (select proposal_id, mart, case when bool_or(by_field) then 'field' when bool_or(by_token) then 'token' else 'none' end as match
      from pairs group by 1, 2)
    select b.proposal_id, b.mart, b.match, coalesce(string_agg(dim, '|' order by position)
      filter ((match = 'field' and by_field) or (match = 'token' and by_token)), '') as dimensions
    from best b join pairs p on b.proposal_id = p.proposal_id and b.mart = p.mart group by 1, 2, 3""",
)


@REG.query(
    "spec_from_proposal",
    f"""with {STG_SQL} select strftime(date_trunc('month', order_date), '%Y-%m-%d') as order_date_month, cast(sum(revenue) as double) as revenue
    from stg group by 1""",
)
def spec_from_proposal(spark: SparkSession, sf: str) -> DataFrame:
    """From an accepted proposal and its dataset's mappings to a mart over the feed. Only that one spec, a few names long, comes
    to the driver."""
    row = accepted(spark, sf).orderBy("proposal_id").first()
    if row is None:
        return spark.range(0).selectExpr("cast(null as date) as order_date_month", "cast(null as decimal(38,2)) as revenue")
    mapped = effective(spark, sf).filter(F.col("dataset_id") == row["dataset_id"]).collect()
    mappings = S.to_mappings(mapped)
    models = S.build_models(retail_feed(spark, sf, [m.raw_name for m in mappings]), mappings, S.to_spec(row))
    return models["mart_monthly_revenue"]


REG.add(
    "catalog_terms",
    lambda s, d: P.catalog_terms(P.catalog(accepted(s, d)), ["proposal_id"]),
    f"""with {ACCEPTED_SQL}, f as (select proposal_id, lower(unnest(list_concat(dimensions, metrics))) as field from good_marts)
    select proposal_id, unnest(['sales', 'performance', 'trend', 'monthly', 'month', 'compare', 'comparison', 'breakdown']) as term from good
    union select proposal_id, lower(name) from good_marts union select * from f
    union select proposal_id, part from (select proposal_id, unnest(string_split(field, '_')) as part from f) where part <> ''""",
)
