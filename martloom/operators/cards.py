"""Dashboard cards: result documents and their children, open result groups and card decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.operators.runlog import MAX_CARDS, is_deleted

SNAPSHOT_TASKS = ("analysis_plan", "insight_generation")


def snapshot_headers(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """One document per run: its dataset and the run itself, without its children."""
    side = datasets.select(
        F.col("dataset_id").alias("__id"), "dataset_name", "source_type",
        F.col("status").alias("__status"), "deleted_at",
    )
    joined = runs.join(side, F.col("dataset_id") == F.col("__id"), "left")
    document = F.struct(
        F.lit(1).alias("snapshot_version"),
        F.struct(
            F.col("dataset_id").alias("id"), F.col("dataset_name").alias("name"), "source_type",
            F.col("__status").alias("status"),
            is_deleted(F.col("__id"), F.col("deleted_at"), F.col("__status")).alias("deleted"), "deleted_at",
        ).alias("dataset"),
        F.struct(
            F.col("run_id").alias("id"), "question", F.col("status").alias("status"), "source_model", "row_count",
            F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("completed_at"),
        ).alias("analysis_run"),
    )
    return joined.select("run_id", document.alias("card_snapshot"))


def snapshot_children(charts: DataFrame, insights: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per chart, insight and provider attempt of a run, with its place among its kind.

    A run's children stay rows: a document that nests them would grow with the run.
    """

    def child(df: DataFrame, kind: str, item_id: str, order: Column, label: str, status: Column) -> DataFrame:
        return df.select(
            "run_id", F.lit(kind).alias("kind"), order.cast("string").alias("sort_key"), F.col(item_id).cast("string").alias("id"),
            F.col(label).alias("label"), status.cast("string").alias("status"),
        )

    padded = lambda c: F.lpad(c.cast("string"), 12, "0")
    tried = attempts.filter(F.col("task_type").isin(*SNAPSHOT_TASKS))
    return (
        child(charts, "chart", "chart_id", padded(F.col("sort_order")), "chart_type", F.lit(None))
        .unionByName(child(insights, "insight", "insight_id", padded(F.col("sort_order")), "insight_level", F.col("status")))
        .unionByName(child(tried, "provider_run", "attempt_id", F.date_format("created_at", "yyyyMMddHHmmssSSSSSS"), "lane", F.col("status")))
    )


def mark_deleted(snapshot: Column, deleted: Column, deleted_at: Column) -> Column:
    """Stamp the dataset inside a document whose dataset is gone; leave other documents alone."""
    stamped = snapshot.withField("dataset.deleted", F.lit(True)).withField("dataset.deleted_at", deleted_at)
    return F.when(deleted, stamped).otherwise(snapshot)


def open_result_groups(runs: DataFrame, charts: DataFrame, cards: DataFrame) -> DataFrame:
    """Completed runs with charts that no active card shows."""
    shown = cards.filter(F.col("status") == "active").select("run_id")
    return (
        runs.filter(F.col("status") == "completed")
        .join(charts.select("run_id"), "run_id", "left_semi")
        .join(shown, "run_id", "left_anti")
    )


def active_cards(cards: DataFrame) -> DataFrame:
    listed = cards.filter(F.col("status") == "active")
    return listed.orderBy("session_id", F.col("sort_order").asc(), F.col("created_at").asc(), "card_id")


def decisions(runs: DataFrame, charts: DataFrame, cards: DataFrame, max_cards: int = MAX_CARDS) -> DataFrame:
    """What adding each run to the dashboard would do.

    An active card is kept whatever the run's state; a card is restored before the session's card
    limit is looked at, and only a new card counts against it.
    """
    by_run = cards.groupBy("run_id").agg(
        F.bool_or(F.col("status") == "active").alias("__active"),
        F.bool_or(F.col("status") == "archived").alias("__archived"),
    )
    used = cards.groupBy("session_id").agg(
        F.count(F.when(F.col("status").isin("active", "archived"), 1)).alias("cards_used")
    )
    chart_counts = charts.groupBy("run_id").agg(F.count("*").alias("__charts"))
    joined = (
        runs.join(by_run, "run_id", "left").join(chart_counts, "run_id", "left").join(used, "session_id", "left")
    )
    decision = (
        F.when(F.coalesce("__active", F.lit(False)), "keep")
        .when(F.col("status") != "completed", "analysis_not_completed")
        .when(F.col("__charts").isNull(), "analysis_has_no_charts")
        .when(F.coalesce("__archived", F.lit(False)), "restore")
        .when(F.coalesce("cards_used", F.lit(0)) >= max_cards, "card_limit_reached")
        .otherwise("create")
    )
    return joined.select("run_id", "session_id", decision.alias("decision"))
