"""Screens for machine-written questions and insights."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions import documents as D
from martloom.functions.names import SAFE_NAME, collapse_spaces, strip_all
from martloom.functions.text import PLAN_SECRET_MARKERS, SECRET_MARKERS, contains_any
from martloom.operators.proposals import BASE_TERMS
from martloom.operators.unnest import unbroadcast, unnest

# Entries a reader of the first few would see, and the longest texts.
QUESTIONS, QUESTION_LENGTH, INTENT_LENGTH = 5, 180, 128
FINDINGS, FINDING_LENGTH, SUMMARY_LENGTH, TAG_LENGTH, CHART_INSIGHTS = 5, 240, 800, 32, 3
# Words that point at raw columns rather than marts (plain substrings).
RAW_ONLY_TERMS = (
    "payment", "payment method", "discount", "discount amount", "unit price", "cost", "customer name",
    "customer id", "product id", "store id", "order id", "order line", "raw",
)
# Fixed value: a claim that something to come is there.
READY_CLAIM = "(dashboard|chart|insight).{0,40}(ready|created|generated)"
# Phrases an insight cannot support, and the tags and confidences it may carry.
UNSUPPORTED_CLAIMS = (
    "entire dataset", "complete dataset", "all customers", "all products", "caused by", "proves that",
)
TAGS = (
    "trend", "breakdown", "anomaly", "kpi", "comparison", "recommendation", "data_quality", "revenue",
    "product", "customer", "store", "table",
)
CONFIDENCES = ("low", "medium", "high")


def terms_of(marts: dict[str, dict]) -> list[str]:
    """Catalog words of a small mart catalog."""
    fields = [f.lower() for m in marts.values() for f in (*m["metrics"], *m["dimensions"])]
    words = [*BASE_TERMS, *(name.lower() for name in marts), *fields, *(p for f in fields for p in f.split("_") if p)]
    return list(dict.fromkeys(words))


def _any_of(words) -> str:
    """One pattern for a list of substrings, so a text is read once whatever the list's length."""
    return "|".join(re.escape(w) for w in words)


def screen_questions(payloads: DataFrame, terms: list[str], catalogs: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """All suggested questions of each payload, with every rule they break.

    A question must hold a catalog term: one of ``terms``, or, where ``catalogs`` (``keys``, ``term``) has terms for the payload's ``keys``,
    one of those alone. A catalog's terms meet its payloads as one row, so questions are not multiplied. ``kept`` marks the first good one among questions that differ only in case; a bad spelling before it does not
    count. ``within_limit`` says which questions a reader of the first few would see. A payload that is unusable as
    a whole has one row at position -1. Members of the wrong type count as unusable text.
    """
    read = payloads
    if catalogs is not None:
        # One catalog's words, as many as its marts have fields.
        own = catalogs.groupBy(*keys).agg(F.collect_set("term").alias("__terms"))
        read = read.join(unbroadcast(own), keys, "left")
    read = read.withColumn("doc", D.parse(F.col("payload")))
    read = read.withColumn("items", D.items(F.col("doc"), "$.suggested_questions"))
    stop = (
        F.when(contains_any(F.col("payload"), PLAN_SECRET_MARKERS), "secret_text")
        .when(F.col("doc").isNull(), "not_json_object")
        .when(F.coalesce(F.size("items"), F.lit(0)) < 1, "questions_required")
    )
    cleaned = F.transform(
        "items",
        lambda q: F.struct(
            collapse_spaces(D.text(q, "$.question")).alias("question"), collapse_spaces(D.text(q, "$.intent")).alias("intent"),
            (~D.is_missing(q, "$.intent")).alias("intent_given"),
        ),
    )
    rule = lambda name, broken: F.when(F.coalesce(broken, F.lit(False)), F.lit(name))

    def has_term(lowered: Column) -> Column:
        known = lowered.rlike(_any_of(terms))
        if catalogs is None:
            return known
        return F.when(F.col("__terms").isNull(), known).otherwise(F.exists("__terms", lambda t: F.contains(lowered, t)))

    def judged(q: Column) -> Column:
        question, lowered = q["question"], F.lower(q["question"])
        length = F.coalesce(F.length(question), F.lit(0))
        intent_ok = (F.length(q["intent"]) <= INTENT_LENGTH) & q["intent"].rlike(SAFE_NAME)
        broken = F.array_compact(
            F.array(
                rule("text", (length < 1) | (length > QUESTION_LENGTH)),
                rule("no_question_mark", ~F.contains(question, F.lit("?"))),
                rule("raw_only_term", lowered.rlike(_any_of(RAW_ONLY_TERMS))),
                rule("no_catalog_term", ~has_term(lowered)),
                rule("claims_ready", lowered.rlike(READY_CLAIM)),
                rule("intent", q["intent_given"] & ~F.coalesce(intent_ok, F.lit(False))),
            )
        )
        return F.struct(question.alias("question"), lowered.alias("key"), F.array_join(broken, "|").alias("violations"))

    prepared = read.withColumns({"stop": stop, "cleaned": cleaned}).withColumn(
        "judged", F.transform("cleaned", judged)
    )
    # Keys of good questions in place, so the first good one is found by position.
    keys = prepared.withColumn("keys", F.transform("judged", lambda q: F.when(q["violations"] == "", q["key"])))
    rows = keys.select(
        "payload_id", "stop", "keys",
        F.posexplode_outer(F.when(F.col("stop").isNull(), F.col("judged"))).alias("position", "q"),
    )
    first = F.array_position("keys", F.col("q.key")) == F.col("position") + 1
    return rows.select(
        "payload_id", F.coalesce("position", F.lit(-1)).alias("position"), F.col("q.question").alias("question"),
        F.coalesce("stop", "q.violations").alias("violations"),
        F.coalesce((F.col("q.violations") == "") & first, F.lit(False)).alias("kept"),
        (F.coalesce("position", F.lit(-1)) < QUESTIONS).alias("within_limit"),
    )


def first_of_each(questions: DataFrame, scope: list[str], position: list[str], text: str) -> DataFrame:
    """Ordered de-duplication that ignores case: the earliest spelling of each question stays."""
    return (
        questions.groupBy(*scope, F.lower(text).alias("__key"))
        .agg(F.min(F.struct(*position, text)).alias("__first"))
        .select(*scope, "__first.*")
    )


def screen_insights(payloads: DataFrame, charts: DataFrame) -> DataFrame:
    """The question insight and all chart insights of each payload, with the rules they break.

    ``charts`` (run_id, chart_id, title, sort_order) says what a chart insight may refer to, by id or by title; of charts with
    one title the last in order counts. ``within_limit`` is false for a chart insight beyond the first few, and ``finding_within_limit``
    says whether a bad finding is among the first few. Members of the wrong type break the rule of their place.
    """
    read = payloads.withColumn("doc", D.parse(F.col("payload")))
    doc = F.col("doc")
    read = read.withColumns({
        "question": F.when(D.is_object(doc, "$.question_insight"), D.member(doc, "$.question_insight")),
        "charted": D.items(doc, "$.chart_insights"),
    })
    stop = (
        F.when(contains_any(F.col("payload"), SECRET_MARKERS), "secret_text")
        .when(doc.isNull(), "not_json_object")
        .when(F.col("question").isNull(), "question_insight_required")
        .when((D.kind(doc, "$.chart_insights") != "") & F.col("charted").isNull(), "chart_insights_list")
    )
    nonblank = lambda c: F.when(strip_all(c) != "", strip_all(c))

    def typed(i: Column) -> Column:
        """Members of one insight; text where text was given, NULL for anything else."""
        tag = lambda t: F.replace(F.lower(collapse_spaces(D.text(t))), F.lit(" "), F.lit("_"))
        # A chart id of another type gives way to the title, as a missing one does; a false or empty one to the other id.
        empty_id = D.is_missing(i, "$.chart_id") | (F.coalesce(D.text(i, "$.chart_id"), F.lit("x")) == "")
        chart = F.when(empty_id, D.text(i, "$.analysis_run_chart_id")).otherwise(D.text(i, "$.chart_id"))
        return F.struct(
            collapse_spaces(D.text(i, "$.summary")).alias("summary"),
            D.is_object(i).alias("is_object"),
            (D.is_missing(i, "$.key_findings") | D.is_list(i, "$.key_findings")).alias("findings_ok"),
            F.transform(D.items(i, "$.key_findings"), lambda f: collapse_spaces(D.text(f))).alias("findings"),
            (D.is_missing(i, "$.tags") | D.is_list(i, "$.tags")).alias("tags_ok"),
            F.transform(D.items(i, "$.tags"), tag).alias("tags"),
            F.lower(collapse_spaces(D.text(i, "$.confidence"))).alias("confidence"),
            F.coalesce(nonblank(chart), nonblank(D.text(i, "$.chart_title"))).alias("reference"),
        )

    items = F.concat(F.array("question"), F.coalesce("charted", F.array().cast("array<variant>")))
    rows = read.withColumn("stop", stop).select(
        "run_id", "stop",
        F.posexplode_outer(F.when(F.col("stop").isNull(), F.transform(items, typed))).alias("position", "i"),
    )
    no_text = F.array().cast("array<string>")
    parts = rows.select(
        "run_id", "stop", F.coalesce("position", F.lit(-1)).alias("position"), "i.summary", "i.is_object", "i.findings_ok", "i.tags_ok",
        F.coalesce("i.findings", no_text).alias("findings"), F.coalesce("i.tags", no_text).alias("tags"),
        "i.confidence", "i.reference",
    )
    on_chart = F.col("position") > 0
    claims = _any_of(UNSUPPORTED_CLAIMS)
    bad_length = lambda c, cap: (F.coalesce(F.length(c), F.lit(0)) < 1) | (F.length(c) > cap)
    bad_finding = lambda f: bad_length(f, FINDING_LENGTH) | F.coalesce(F.lower(f).rlike(claims), F.lit(False))
    rule = lambda name, broken: F.when(F.coalesce(broken, F.lit(False)), F.lit(name))
    texts = F.array_compact(
        F.array(
            rule("summary_text", bad_length(F.col("summary"), SUMMARY_LENGTH)),
            rule("summary_claim", F.lower("summary").rlike(claims)),
            rule("findings_list", ~F.col("findings_ok")),
            rule("finding_text", F.exists("findings", lambda f: bad_length(f, FINDING_LENGTH))),
            rule("finding_claim", F.exists("findings", lambda f: F.coalesce(F.lower(f).rlike(claims), F.lit(False)))),
            rule("tags_list", ~F.col("tags_ok")),
            rule("tag", F.exists("tags", lambda t: bad_length(t, TAG_LENGTH) | ~F.coalesce(t.isin(*TAGS), F.lit(False)))),
            rule("confidence", ~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False))),
        )
    )
    first_bad = F.array_position(F.transform("findings", bad_finding), True)
    # Texts are judged before charts are looked up, so that no text goes through the shuffles of these joins.
    judged = parts.select(
        "run_id", "stop", "position", "is_object", "reference", "confidence", F.array_distinct("tags").alias("tags"),
        texts.alias("texts"), first_bad.between(1, FINDINGS).alias("finding_within_limit"),
    )
    by_id = charts.select("run_id", F.col("chart_id").alias("reference"), "chart_id", "sort_order")
    by_title = charts.select("run_id", F.lower("title").alias("reference"), "chart_id", "sort_order")
    last = F.max_by("chart_id", F.struct("sort_order", "chart_id")).alias("chart_id")
    lookup = by_id.unionByName(by_title).groupBy("run_id", "reference").agg(last)
    exact = judged.join(lookup, ["run_id", "reference"], "left")
    lowered = lookup.select(
        "run_id", F.col("reference").alias("lowered"), F.col("chart_id").alias("chart_by_title")
    )
    found = exact.withColumn("lowered", F.lower("reference")).join(lowered, ["run_id", "lowered"], "left")
    chart = F.coalesce("chart_id", "chart_by_title")
    referred = F.array_compact(
        F.array(
            rule("insight_object", ~F.col("is_object")),
            rule("no_chart_reference", on_chart & F.col("reference").isNull()),
            rule("unknown_chart", on_chart & F.col("reference").isNotNull() & chart.isNull()),
        )
    )
    return found.select(
        "run_id", "position",
        F.when(F.col("position") < 0, F.lit(None)).when(on_chart, "chart").otherwise("question").alias("insight_level"),
        F.coalesce("stop", F.array_join(F.concat(referred, "texts"), "|")).alias("violations"),
        "tags", "confidence", F.when(on_chart, chart).alias("chart_id"),
        (F.col("position") <= CHART_INSIGHTS).alias("within_limit"),
        "finding_within_limit",
    )
