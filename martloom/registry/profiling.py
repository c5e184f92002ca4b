"""Column profiles over the retail feed and over events as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.operators import profiling as P
from martloom.registry.common import Registry
from martloom.registry.retail import RAW_SQL
from martloom.sources.feeds import RETAIL_CONTRACT, retail_feed, table

REG = Registry()

EVENT_COLUMNS = [
    "event_id", "user_id", "event_type", "event_day", "us_day", "amount", "units", "flag", "note", "mixed", "props",
]
# Text columns spelled the same way in both engines; only the day formats differ.
EVENT_TEXT = (
    "cast(event_id as {text}) as event_id",
    "cast(user_id as {text}) as user_id",
    "event_type",
    "{day} as event_day",
    "{us_day} as us_day",
    """case event_type when 'error' then '' when 'view' then 'NULL'
    else cast(cast(value as decimal(18,2)) as {text}) end as amount""",
    "concat(' ', cast(cast(floor(value) as bigint) as {text}), '  ') as units",
    "case event_type when 'click' then 'Yes' when 'view' then 'no' else 'N' end as flag",
    "case event_type when 'click' then ' ' when 'view' then 'null' else 'NULL' end as note",
    "case event_type when 'signup' then 'Null' else '12' end as mixed",
    "props",
)
EVENTS_SQL = "ev as (select event_id as pos, " + ", ".join(EVENT_TEXT).format(
    text="varchar", day="strftime(ts, '%Y-%m-%d')", us_day="strftime(ts, '%m/%d/%Y')"
) + " from events)"


def events_text(spark: SparkSession, sf: str) -> DataFrame:
    spelled = {"text": "string", "day": "date_format(ts, 'yyyy-MM-dd')", "us_day": "date_format(ts, 'MM/dd/yyyy')"}
    return table(spark, sf, "events").selectExpr("event_id as pos", *(c.format(**spelled) for c in EVENT_TEXT))


def long_sql(source: str, columns) -> str:
    return f"""cells as (
      select raw_column_name, pos, case when v in ('', 'NULL', 'null') then null else v end as value
      from (select pos, raw_column_name, regexp_replace(value, '^\\s+|\\s+$', '', 'g') as v
        from {source} unpivot include nulls (value for raw_column_name in ({', '.join(columns)})))),
    counted as (select raw_column_name, value, count(*) as n, min(pos) as first_seen from cells group by 1, 2),
    ranked as (select *, row_number() over (partition by raw_column_name order by first_seen, value) as rk
      from counted where value is not null),
    sampled as (select raw_column_name, string_agg(value, '|' order by rk) as sample_values
      from ranked where rk <= 5 group by 1),
    summary as (
      select raw_column_name, sum(n) as row_count, sum(case when value is null then n else 0 end) as null_count,
        count(value) as unique_count,
        bool_and(lower(value) in ('true','false','yes','no','y','n','0','1')) as is_bool,
        bool_and(regexp_full_match(value, '[+-]?[0-9]+(_[0-9]+)*')) as is_int,
        bool_and(regexp_full_match(value, '[+-]?(([0-9_]*[0-9][0-9_]*\\.?[0-9_]*|\\.[0-9_]*[0-9][0-9_]*)(_*[eE][+-]?[0-9_]*[0-9][0-9_]*)?|(?i:inf|infinity|s?nan[0-9]*))')) as is_dec,
        bool_and(coalesce(case when regexp_full_match(value, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') then try_strptime(value, '%Y-%m-%d') end,
          case when regexp_full_match(value, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') then try_strptime(value, '%Y/%m/%d') end,
          case when regexp_full_match(value, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') then coalesce(try_strptime(value, '%m/%d/%Y'), try_strptime(value, '%d/%m/%Y')) end,
          case when regexp_full_match(value, '\\d{{8}}') then try_strptime(value, '%Y%m%d') end) is not null) as is_date
      from counted group by 1),
    profile as (
      select s.raw_column_name, upper(s.raw_column_name) as normalized_column_name,
        case when unique_count = 0 then 'unknown'
          when s.raw_column_name = 'id' or s.raw_column_name like '%\\_id' escape '\\' or s.raw_column_name like '% id' then 'identifier'
          when is_bool then 'boolean' when is_int then 'integer' when is_dec then 'decimal'
          when is_date then 'date' else 'string' end as detected_type,
        cast(null_count as bigint) as null_count, round(null_count / row_count, 4) as null_rate,
        cast(unique_count as bigint) as unique_count, coalesce(sample_values, '') as sample_values
      from summary s left join sampled using (raw_column_name))"""


def index_sql(columns) -> str:
    return "case raw_column_name " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(columns)) + " end"


RETAIL_SQL = f"""with {RAW_SQL}, placed as (
  select cast(regexp_replace(order_line_id, '[^0-9]', '', 'g') as bigint) as pos, * from raw),
{long_sql('placed', RETAIL_CONTRACT)}"""
EVENT_PROFILE_SQL = f"with {EVENTS_SQL}, {long_sql('ev', EVENT_COLUMNS)}"


def line_place():
    """Order and line number as one number: the line's place in the feed."""
    return F.regexp_replace("order_line_id", "[^0-9]", "").cast("bigint")


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.value_counts(events_text(spark, sf), EVENT_COLUMNS, F.col("pos"))


REG.add(
    "profile_columns",
    lambda s, d: P.profile(retail_feed(s, d), list(RETAIL_CONTRACT), line_place()),
    f"{RETAIL_SQL} select *, cast({index_sql(RETAIL_CONTRACT)} as bigint) as column_index from profile",
)
REG.add(
    "detect_types",
    lambda s, d: P.detect_types(events_text(s, d), EVENT_COLUMNS),
    f"{EVENT_PROFILE_SQL} select raw_column_name, detected_type from profile",
)
REG.add(
    "profile_nulls",
    lambda s, d: P.summarize(event_counts(s, d)).select("raw_column_name", "null_count", "null_rate"),
    f"{EVENT_PROFILE_SQL} select raw_column_name, null_count, null_rate from profile",
)
REG.add(
    "profile_distinct",
    lambda s, d: P.summarize(event_counts(s, d)).select("raw_column_name", "unique_count"),
    f"{EVENT_PROFILE_SQL} select raw_column_name, unique_count from profile",
)
REG.add(
    "profile_samples",
    lambda s, d: P.samples(event_counts(s, d)),
    f"{EVENT_PROFILE_SQL} select raw_column_name, sample_values from sampled",
)
