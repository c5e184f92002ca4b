"""Queries over the run log: latest runs, reuse, fallback chains, history, usage, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions.text import normalize_question
from martloom.operators.sequences import newest, oldest, top_per_key, with_previous

# Session limits.
RETENTION_DAYS = 3
MAX_UPLOAD_MB = 10
MAX_RUNS = 8
MAX_CARDS = 8
HISTORY_ROWS = 10
LIVE_SESSION_STATUSES = ("active", "reset")


def latest_completed(runs: DataFrame) -> DataFrame:
    """Newest completed run that left a summary, per dataset."""
    done = runs.filter((F.col("status") == "completed") & F.col("has_summary"))
    return newest(done, ["dataset_id"], ["created_at", "attempt_id"], ["attempt_id", "created_at"])


def latest_running_job(runs: DataFrame, task: str, job_lane: str = "background_job") -> DataFrame:
    running = runs.filter(
        (F.col("task_type") == task) & (F.col("lane") == job_lane) & (F.col("status") == "running")
    )
    return newest(running, ["dataset_id"], ["created_at", "attempt_id"], ["attempt_id", "created_at"])


def reusable_runs(runs: DataFrame) -> DataFrame:
    """Newest completed run per session, dataset and normalised question."""
    done = runs.filter(F.col("status") == "completed").withColumn(
        "normalized_question", normalize_question(F.col("question"))
    )
    keys = ["session_id", "dataset_id", "normalized_question"]
    return newest(done, keys, ["completed_at", "run_id"], ["run_id", "completed_at"])


def reuse_decisions(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """For each asked question, the run to reuse, or a new one. A session reset plays no part."""
    keys = ["session_id", "dataset_id", "normalized_question"]
    known = reusable_runs(runs).select(*keys, F.col("run_id").alias("reused_run_id"))
    new = asked.withColumn("normalized_question", normalize_question(F.col("question")))
    decision = F.when(F.col("reused_run_id").isNull(), "create_new").otherwise("reuse_existing")
    return new.join(known, keys, "left").withColumn("decision_type", decision)


def fallback_chain(attempts: DataFrame) -> DataFrame:
    """Each attempt with the lane tried just before it for the same task."""
    return with_previous(
        attempts, ["dataset_id", "task_type"], ["created_at", "attempt_id"], "lane", "fallback_from",
        F.date_trunc("day", "created_at"),
    )


def winning_attempts(attempts: DataFrame) -> DataFrame:
    """The first completed attempt per task; whatever follows was not needed."""
    done = attempts.filter(F.col("status") == "completed")
    return oldest(done, ["dataset_id", "task_type"], ["created_at", "attempt_id"], ["attempt_id", "lane"])


def insight_status(insights: DataFrame) -> DataFrame:
    """Completed beats failed, failed beats not started."""
    rank = F.when(F.col("status") == "completed", 2).when(F.col("status") == "failed", 1).otherwise(0)
    return insights.groupBy("run_id").agg(F.max(rank).alias("rank")).select(
        "run_id",
        F.when(F.col("rank") == 2, "completed").when(F.col("rank") == 1, "failed")
        .otherwise("not_started").alias("insight_status"),
    )


def is_deleted(found: Column, deleted_at: Column, status: Column) -> Column:
    """A dataset counts as deleted when it is missing, stamped, or marked."""
    return found.isNull() | deleted_at.isNotNull() | F.coalesce(status == "deleted", F.lit(False))


def with_dataset_flag(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    side = datasets.select(
        F.col("dataset_id").alias("__id"), "dataset_name", F.col("status").alias("__status"), "deleted_at"
    )
    joined = runs.join(side, F.col("dataset_id") == F.col("__id"), "left")
    flag = is_deleted(F.col("__id"), F.col("deleted_at"), F.col("__status"))
    return joined.withColumn("dataset_deleted", flag).drop("__id", "__status", "deleted_at")


def history(
    runs: DataFrame, sessions: DataFrame, datasets: DataFrame, charts: DataFrame, insights: DataFrame
) -> DataFrame:
    """Runs since the session's reset with chart count, insight status and dataset state."""
    return described(since_reset(runs, sessions), datasets, charts, insights)


def since_reset(runs: DataFrame, sessions: DataFrame) -> DataFrame:
    resets = sessions.select("session_id", "reset_at")
    kept = runs.join(resets, "session_id", "left").filter(
        F.col("reset_at").isNull() | (F.col("created_at") > F.col("reset_at"))
    )
    return kept.drop("reset_at")


def described(runs: DataFrame, datasets: DataFrame, charts: DataFrame, insights: DataFrame) -> DataFrame:
    """The given runs with chart count, insight status and dataset state."""
    chart_counts = charts.groupBy("run_id").agg(F.count("*").alias("chart_count"))
    return (
        with_dataset_flag(runs, datasets)
        .join(chart_counts, "run_id", "left")
        .join(insight_status(insights), "run_id", "left")
        .withColumns(
            {
                "chart_count": F.coalesce("chart_count", F.lit(0)).cast("long"),
                "insight_status": F.coalesce("insight_status", F.lit("not_started")),
            }
        )
    )


def newest_first(listing: DataFrame) -> DataFrame:
    return listing.orderBy("session_id", F.col("created_at").desc(), F.col("run_id").desc())


def recent(listing: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """The latest few runs of every session."""
    return top_per_key(
        listing, ["session_id"], [F.col("created_at").desc(), F.col("run_id").desc()], rows
    )


def recent_history(
    runs: DataFrame, sessions: DataFrame, datasets: DataFrame, charts: DataFrame, insights: DataFrame, rows: int = HISTORY_ROWS
) -> DataFrame:
    """The latest few runs of every session, described. Runs are ranked first, so that only charts and insights of those
    that stay are counted."""
    few = recent(since_reset(runs, sessions), rows)
    ids = few.select("run_id")
    return described(few, datasets, charts.join(ids, "run_id", "left_semi"), insights.join(ids, "run_id", "left_semi"))


def sessions_at(sessions: DataFrame, now: Column) -> DataFrame:
    """Live sessions whose retention has run out are expired; others keep their status."""
    expires = F.col("created_at") + F.make_interval(days=F.lit(RETENTION_DAYS))
    over = F.col("status").isin(*LIVE_SESSION_STATUSES) & (expires <= now)
    return sessions.withColumns(
        {"expires_at": expires, "new_status": F.when(over, "expired").otherwise(F.col("status"))}
    )


def usage(log: DataFrame, incoming_mb: Column) -> DataFrame:
    """Use per session and which limits the next upload, run or card would break."""
    totals = log.groupBy("session_id").agg(
        F.coalesce(F.sum("upload_mb"), F.lit(0)).alias("upload_mb_used"),
        F.count(F.when(F.col("kind") == "run", 1)).alias("runs_used"),
        F.count(F.when(F.col("kind") == "card", 1)).alias("cards_used"),
    )
    return totals.withColumns(
        {
            "upload_blocked": F.col("upload_mb_used") + incoming_mb > MAX_UPLOAD_MB,
            "runs_blocked": F.col("runs_used") >= MAX_RUNS,
            "cards_blocked": F.col("cards_used") >= MAX_CARDS,
        }
    )


def preparation_status(datasets: DataFrame, attempts: DataFrame, job_lane: str = "background_job") -> DataFrame:
    """Mapping and question preparation state of each dataset, from what its log holds."""
    mapping_run = F.col("task_type") == "semantic_preparation"
    question_run = F.col("task_type") == "dataset_question_suggestions"
    log = attempts.groupBy(F.col("dataset_id").alias("__id")).agg(
        F.count(F.when(mapping_run, 1)).alias("__mapping_runs"),
        F.count(F.when(question_run, 1)).alias("__question_runs"),
        F.bool_or(mapping_run & (F.col("lane") == job_lane) & (F.col("status") == "running")).alias("__running"),
        F.max_by(
            F.when(mapping_run, F.col("status")),
            F.when(mapping_run, F.struct("created_at", "attempt_id")),
        ).alias("__latest"),
    )
    joined = datasets.join(log, F.col("dataset_id") == F.col("__id"), "left")
    running = F.coalesce("__running", F.lit(False)) & ~F.col("has_columns")
    any_mapping = F.coalesce("__mapping_runs", F.lit(0)) > 0
    any_question = F.coalesce("__question_runs", F.lit(0)) > 0
    failed_last = F.coalesce(F.col("__latest").isin("failed", "unavailable"), F.lit(False))
    rest = (
        F.when(F.col("has_columns"), "completed").when(any_mapping, "failed").otherwise("not_started")
    )
    return joined.select(
        "dataset_id",
        F.when(running, "running").otherwise(rest).alias("mapping_status"),
        # The variant a failed attempt reports right after it ran.
        F.when(running, "running").when(failed_last, "failed").otherwise(rest).alias("mapping_status_after_run"),
        F.when(F.col("has_questions"), "completed")
        .when(F.col("status") != "ready_for_analysis", "not_started")
        .when(any_question, "failed")
        .otherwise("not_started")
        .alias("question_status"),
    )
