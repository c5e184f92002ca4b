"""Run log, cards and usage over the workspace log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.operators import admission as A
from martloom.operators import cards as K
from martloom.operators import lineage as L
from martloom.operators import runlog as R
from martloom.registry.common import Registry
from martloom.sources.feeds import table
from martloom.sources.workspace import LOG_TABLES, log_table

REG = Registry()


def logs(*names: str) -> str:
    """The log tables as common table expressions."""
    return ", ".join(
        f"{n} as (select {', '.join(LOG_TABLES[n][1])} from {LOG_TABLES[n][0]})" for n in names
    )


def stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S') as {col}"


def stamped(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


NORMALIZED = """regexp_replace(lower(regexp_replace(regexp_replace({q}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')), '[ ?!.]+$', '')"""
DELETED = "(d.dataset_id is null or d.deleted_at is not null or coalesce(d.status = 'deleted', false))"

REG.add(
    "active_datasets",
    lambda s, d: log_table(s, d, "datasets")
    .filter(F.col("deleted_at").isNull())
    .select("dataset_id", "session_id", "dataset_name", (F.col("status") == "ready_for_analysis").alias("ready")),
    f"""with {logs('datasets')} select dataset_id, session_id, dataset_name, status = 'ready_for_analysis' as ready
    from datasets where deleted_at is null""",
)
REG.add(
    "deleted_flag",
    lambda s, d: R.with_dataset_flag(log_table(s, d, "runs"), log_table(s, d, "datasets")).select(
        "run_id", "dataset_name", "dataset_deleted"
    ),
    f"""with {logs('runs', 'datasets')} select run_id, dataset_name, {DELETED} as dataset_deleted
    from runs r left join datasets d on r.dataset_id = d.dataset_id""",
)
REG.add(
    "available_result_groups",
    lambda s, d: K.open_result_groups(
        log_table(s, d, "runs"), log_table(s, d, "charts"), log_table(s, d, "cards")
    ).select("run_id", "session_id", "question"),
    f"""with {logs('runs', 'charts', 'cards')} select run_id, session_id, question from runs
    where status = 'completed' and run_id in (select run_id from charts)
      and run_id not in (select run_id from cards where status = 'active')""",
)
STATUS_SQL = """ranked as (select run_id, max(case status when 'completed' then 2 when 'failed' then 1 else 0 end) as rk
  from insights group by 1),
insight_status as (select run_id, case rk when 2 then 'completed' when 1 then 'failed' else 'not_started' end as insight_status
  from ranked)"""
REG.add(
    "insight_status_rollup",
    lambda s, d: R.insight_status(log_table(s, d, "insights")),
    f"with {logs('insights')}, {STATUS_SQL} select * from insight_status",
)


HISTORY_TABLES = ("runs", "sessions", "datasets", "charts", "insights")
HISTORY_FIELDS = (
    "run_id", "session_id", "dataset_name", "dataset_deleted", "status", "source_model", "chart_count",
    "insight_status", "created_at",
)


def history(spark: SparkSession, sf: str) -> DataFrame:
    return R.history(*(log_table(spark, sf, n) for n in HISTORY_TABLES)).select(*HISTORY_FIELDS)


HISTORY_SQL = f"""{logs('runs', 'sessions', 'datasets', 'charts', 'insights')}, {STATUS_SQL},
counts as (select run_id, count(*) as chart_count from charts group by 1),
history as (
  select r.run_id, r.session_id, dataset_name, {DELETED} as dataset_deleted, r.status, source_model,
    coalesce(chart_count, 0) as chart_count, coalesce(insight_status, 'not_started') as insight_status, created_at
  from runs r left join sessions s on r.session_id = s.session_id
  left join datasets d on r.dataset_id = d.dataset_id
  left join counts c on r.run_id = c.run_id left join insight_status i on r.run_id = i.run_id
  where s.reset_at is null or r.created_at > s.reset_at)"""
HISTORY_COLUMNS = f"""run_id, session_id, dataset_name, dataset_deleted, status, source_model, chart_count,
  insight_status, {stamp('created_at')}"""
REG.add(
    "run_history",
    lambda s, d: stamped(R.newest_first(history(s, d)), "created_at"),
    f"with {HISTORY_SQL} select {HISTORY_COLUMNS} from history order by session_id, history.created_at desc, run_id desc",
)
REG.add(
    "workspace_history",
    lambda s, d: stamped(
        R.recent_history(*(log_table(s, d, n) for n in HISTORY_TABLES)).select(*HISTORY_FIELDS), "created_at"
    ),
    f"""with {HISTORY_SQL} select {HISTORY_COLUMNS} from history
    qualify row_number() over (partition by session_id order by history.created_at desc, run_id desc) <= 10""",
)
REG.add(
    "latest_completed_run",
    lambda s, d: stamped(R.latest_completed(log_table(s, d, "attempts")), "created_at"),
    f"""with {logs('attempts')} select dataset_id, attempt_id, {stamp('created_at')} from attempts
    where status = 'completed' and has_summary
    qualify row_number() over (partition by dataset_id order by attempts.created_at desc, attempt_id desc) = 1""",
)
REG.add(
    "latest_running_job",
    lambda s, d: stamped(
        R.latest_running_job(log_table(s, d, "attempts"), "semantic_preparation"), "created_at"
    ),
    f"""with {logs('attempts')} select dataset_id, attempt_id, {stamp('created_at')} from attempts
    where status = 'running' and lane = 'background_job' and task_type = 'semantic_preparation'
    qualify row_number() over (partition by dataset_id order by attempts.created_at desc, attempt_id desc) = 1""",
)
REUSABLE_SQL = f"""reusable as (
  select session_id, dataset_id, {NORMALIZED.format(q='question')} as normalized_question, run_id, completed_at
  from runs where status = 'completed'
  qualify row_number() over (partition by session_id, dataset_id, {NORMALIZED.format(q='question')}
    order by completed_at desc, run_id desc) = 1)"""
REG.add(
    "reusable_run",
    lambda s, d: stamped(R.reusable_runs(log_table(s, d, "runs")), "completed_at"),
    f"""with {logs('runs')}, {REUSABLE_SQL} select session_id, dataset_id, normalized_question, run_id,
    {stamp('completed_at')} from reusable""",
)
REG.add(
    "reuse_decision",
    lambda s, d: R.reuse_decisions(
        log_table(s, d, "runs").filter(F.col("status") == "running").select(
            F.col("run_id").alias("request_id"), "session_id", "dataset_id", "question"
        ),
        log_table(s, d, "runs"),
    ).select("request_id", "normalized_question", "reused_run_id", "decision_type"),
    f"""with {logs('runs')}, {REUSABLE_SQL}, asked as (select run_id as request_id, session_id, dataset_id,
      {NORMALIZED.format(q='question')} as normalized_question from runs where status = 'running')
    select request_id, a.normalized_question, r.run_id as reused_run_id,
      case when r.run_id is null then 'create_new' else 'reuse_existing' end as decision_type
    from asked a left join reusable r on a.session_id = r.session_id and a.dataset_id = r.dataset_id
      and a.normalized_question = r.normalized_question""",
)
REG.add(
    "provider_fallback_chain",
    lambda s, d: R.fallback_chain(log_table(s, d, "attempts")).select(
        "attempt_id", "dataset_id", "task_type", "lane", "status", "fallback_from"
    ),
    f"""with {logs('attempts')} select attempt_id, dataset_id, task_type, lane, status,
    lag(lane) over (partition by dataset_id, task_type order by created_at, attempt_id) as fallback_from from attempts""",
)
REG.add(
    "provider_winner",
    lambda s, d: R.winning_attempts(log_table(s, d, "attempts")),
    f"""with {logs('attempts')} select dataset_id, task_type, attempt_id, lane from attempts where status = 'completed'
    qualify row_number() over (partition by dataset_id, task_type order by created_at, attempt_id) = 1""",
)


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A session per user: it starts with the first event and its last event decides its state."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    state = F.when(last == "error", "closed").when(last == "signup", "reset").otherwise("active")
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(
        F.min("ts").alias("created_at"), state.alias("status")
    )


REG.add(
    "expired_sessions",
    lambda s, d: stamped(
        R.sessions_at(event_sessions(s, d), F.lit("2024-01-04 12:00:00").cast("timestamp")),
        "created_at", "expires_at",
    ),
    f"""with sessions as (select user_id as session_id, min(ts) as created_at,
      case arg_max(event_type, struct_pack(a := ts, b := event_id)) when 'error' then 'closed' when 'signup' then 'reset'
        else 'active' end as status from events group by 1)
    select session_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at,
      strftime(created_at + interval 3 day, '%Y-%m-%d %H:%M:%S') as expires_at,
      case when status in ('active', 'reset') and created_at + interval 3 day <= timestamp '2024-01-04 12:00:00'
        then 'expired' else status end as new_status from sessions""",
)
USAGE_KIND = """case event_type when 'purchase' then 'upload' when 'view' then 'run' when 'signup' then 'card'
  else 'other' end"""
USAGE_MB = "case when event_type = 'purchase' then cast(value / 250 as decimal(18,4)) end"
REG.add(
    "usage_limits",
    lambda s, d: R.usage(
        table(s, d, "events").selectExpr(
            "user_id as session_id", f"{USAGE_KIND} as kind", f"{USAGE_MB} as upload_mb"
        ),
        F.lit(2).cast("decimal(18,4)"),
    ),
    f"""with t as (select user_id as session_id, {USAGE_KIND} as kind, {USAGE_MB} as upload_mb from events),
    u as (select session_id, coalesce(sum(upload_mb), 0) as mb, count(case when kind = 'run' then 1 end) as runs_used,
      count(case when kind = 'card' then 1 end) as cards_used from t group by 1)
    select session_id, cast(mb as double) as upload_mb_used, runs_used, cards_used, mb + 2 > 10 as upload_blocked,
      runs_used >= 8 as runs_blocked, cards_used >= 8 as cards_blocked from u""",
)
UPLOAD_UNITS = "cast(cast(value / 250 as decimal(18,4)) * 10000 as bigint)"


@REG.query(
    "admission_replay",
    f"""with recursive t as (select user_id as session_id, event_id, case when event_type = 'purchase' then {UPLOAD_UNITS} else 0 end as size,
        row_number() over (partition by user_id order by ts, event_id) as rn from events),
    r as (select session_id, event_id, rn, cast(0 as bigint) as used_before, size <= 100000 as admitted, case when size <= 100000 then size else 0 end as used from t where rn = 1
      union all select t.session_id, t.event_id, t.rn, r.used, r.used + t.size <= 100000, case when r.used + t.size <= 100000 then r.used + t.size else r.used end
      from r join t on t.session_id = r.session_id and t.rn = r.rn + 1)
    select session_id, event_id, used_before, admitted from r""",
)
def admission_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of a session with the use at that moment, in ten-thousandths of a megabyte; purchases are uploads. Slices are weeks."""
    log = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", F.expr(f"case when event_type = 'purchase' then {UPLOAD_UNITS} end").alias("size"))
    found = A.replay(log, F.col("size"), ["ts", "event_id"], F.date_trunc("week", "ts"), R.MAX_UPLOAD_MB * 10_000)
    return found.select("session_id", "event_id", "used_before", "admitted")


REG.add(
    "prep_status",
    lambda s, d: R.preparation_status(log_table(s, d, "datasets"), log_table(s, d, "attempts")),
    f"""with {logs('datasets', 'attempts')}, log as (
      select dataset_id, count(case when task_type = 'semantic_preparation' then 1 end) as mapping_runs,
        count(case when task_type = 'dataset_question_suggestions' then 1 end) as question_runs,
        bool_or(task_type = 'semantic_preparation' and lane = 'background_job' and status = 'running') as is_running
      from attempts group by 1),
    latest as (select dataset_id, status as latest from attempts where task_type = 'semantic_preparation'
      qualify row_number() over (partition by dataset_id order by created_at desc, attempt_id desc) = 1),
    j as (select d.*, coalesce(mapping_runs, 0) as mapping_runs, coalesce(question_runs, 0) as question_runs,
      coalesce(is_running, false) and not has_columns as busy, coalesce(latest in ('failed', 'unavailable'), false) as bad
      from datasets d left join log l on d.dataset_id = l.dataset_id left join latest t on d.dataset_id = t.dataset_id)
    select dataset_id,
      case when busy then 'running' when has_columns then 'completed' when mapping_runs > 0 then 'failed' else 'not_started' end as mapping_status,
      case when busy then 'running' when bad then 'failed' when has_columns then 'completed' when mapping_runs > 0 then 'failed'
        else 'not_started' end as mapping_status_after_run,
      case when has_questions then 'completed' when status <> 'ready_for_analysis' then 'not_started'
        when question_runs > 0 then 'failed' else 'not_started' end as question_status from j""",
)

# ---- cards --------------------------------------------------------------------------------------


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return K.snapshot_headers(log_table(spark, sf, "runs"), log_table(spark, sf, "datasets"))


def snapshot_children(spark: SparkSession, sf: str) -> DataFrame:
    # Attempts hang off the run that carries the same number as their dataset.
    attempts = log_table(spark, sf, "attempts").withColumnRenamed("dataset_id", "run_id")
    return K.snapshot_children(log_table(spark, sf, "charts"), log_table(spark, sf, "insights"), attempts)


SNAPSHOT_SQL = f"""{logs('runs', 'datasets')},
snapshot as (
  select r.run_id, r.dataset_id, d.dataset_name, d.source_type, d.status as dataset_status, {DELETED} as deleted, d.deleted_at, r.question, r.status,
    r.source_model, r.row_count, strftime(r.completed_at, '%Y-%m-%dT%H:%M:%S') as completed_at
  from runs r left join datasets d on r.dataset_id = d.dataset_id)"""
SNAPSHOT_FIELDS = (
    "run_id", "card_snapshot.dataset.id as dataset_id", "card_snapshot.dataset.name as dataset_name", "card_snapshot.dataset.source_type as source_type",
    "card_snapshot.dataset.status as dataset_status", "card_snapshot.dataset.deleted as deleted", "card_snapshot.dataset.deleted_at as deleted_at",
    "card_snapshot.analysis_run.question as question", "card_snapshot.analysis_run.status as status",
    "card_snapshot.analysis_run.source_model as source_model", "card_snapshot.analysis_run.row_count as row_count",
    "card_snapshot.analysis_run.completed_at as completed_at",
)
REG.add(
    "card_snapshot",
    lambda s, d: snapshots(s, d).selectExpr(*SNAPSHOT_FIELDS),
    f"with {SNAPSHOT_SQL} select * from snapshot",
)
REG.add(
    "card_children",
    snapshot_children,
    f"""with {logs('charts', 'insights', 'attempts')}
    select run_id, 'chart' as kind, lpad(cast(sort_order as varchar), 12, '0') as sort_key, chart_id as id, chart_type as label, null as status from charts
    union all select run_id, 'insight', lpad(cast(sort_order as varchar), 12, '0'), insight_id, insight_level, status from insights
    union all select dataset_id, 'provider_run', strftime(created_at, '%Y%m%d%H%M%S%f'), cast(attempt_id as varchar), lane, status
    from attempts where task_type in ('analysis_plan', 'insight_generation')""",
)
REG.add(
    "snapshot_mark_deleted",
    # A dataset goes when its number is even; its snapshots are stamped, the others stay as they were taken.
    lambda s, d: snapshots(s, d).withColumn(
        "card_snapshot",
        K.mark_deleted(
            F.col("card_snapshot"), F.coalesce(F.col("card_snapshot.dataset.id") % 2 == 0, F.lit(False)), F.lit("2024-03-01")
        ),
    ).selectExpr(*SNAPSHOT_FIELDS),
    f"""with {SNAPSHOT_SQL} select * replace (deleted or coalesce(dataset_id % 2 = 0, false) as deleted,
      case when dataset_id % 2 = 0 then '2024-03-01' else deleted_at end as deleted_at) from snapshot""",
)
REG.add(
    "active_cards",
    lambda s, d: stamped(K.active_cards(log_table(s, d, "cards")), "created_at"),
    f"""with {logs('cards')} select card_id, run_id, session_id, dataset_id, status, sort_order, {stamp('created_at')}
    from cards where status = 'active' order by session_id, sort_order, cards.created_at, card_id""",
)
def of_pairs(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A log table whose sessions belong to two customers each, so that some reach the card limit and some don't."""
    source, columns = LOG_TABLES[name]
    return table(spark, sf, source).selectExpr(*(c.replace("o_custkey % 25", PAIR) for c in columns))


PAIR = "cast(floor(o_custkey / 2) as bigint)"
REG.add(
    "card_decision",
    lambda s, d: K.decisions(of_pairs(s, d, "runs"), log_table(s, d, "charts"), of_pairs(s, d, "cards")),
    f"""with {logs('runs', 'cards').replace('o_custkey % 25', PAIR)}, {logs('charts')},
    used as (select session_id, count(*) as n from cards where status in ('active', 'archived') group by 1)
    select run_id, r.session_id, case
      when run_id in (select run_id from cards where status = 'active') then 'keep'
      when r.status <> 'completed' then 'analysis_not_completed'
      when run_id not in (select run_id from charts) then 'analysis_has_no_charts'
      when run_id in (select run_id from cards where status = 'archived') then 'restore'
      when coalesce(n, 0) >= 8 then 'card_limit_reached' else 'create' end as decision
    from runs r left join used u on r.session_id = u.session_id""",
)

# ---- layers -------------------------------------------------------------------------------------

LAYER_VALUES = ", ".join(f"({i}, '{kind}', '{label}')" for i, (kind, label) in enumerate(L.LAYERS))
REG.add(
    "layer_nodes",
    lambda s, d: L.layer_nodes(log_table(s, d, "datasets")),
    f"""with {logs('datasets')}, layers(position, node_type, label) as (values {LAYER_VALUES})
    select dataset_id, cast(position as bigint) as position, node_type, label,
      case when position < 2 or status = 'ready_for_analysis' then 'completed' when status = 'transforming' then 'waiting'
        else 'not_started' end as node_status from datasets cross join layers""",
)
REG.add(
    "layer_edges",
    lambda s, d: L.layer_edges(log_table(s, d, "datasets")),
    f"""with {logs('datasets')}, layers(position, node_type, label) as (values {LAYER_VALUES}),
    chained as (select node_type as from_node, lead(node_type) over (order by position) as to_node from layers)
    select dataset_id, from_node, to_node, 'prepares' as edge_type from datasets cross join chained where to_node is not null""",
)
