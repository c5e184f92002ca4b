"""Steps whose room must follow their input: joins with unfolded mappings, members of many groups."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from martloom.operators import distinct_counts
from martloom.operators import mapping as M
from martloom.operators import proposals as P
from martloom.operators import screening as Z
from martloom.operators.unnest import unbroadcast

COLUMNS = ("order_id", "order_date", "revenue")
SPEC = {
    "grain": "one row per order", "dimensions": [{"name": "dim_order", "key_column": "order_id", "columns": ["order_id", "colour"]}],
    "fact_table": {"name": "fact_sales", "keys": ["order_id"], "measures": ["revenue"], "degenerate_dimensions": [], "date_columns": ["order_date"]},
    "marts": [{"name": "mart_months", "dimensions": ["order_date_month"], "metrics": ["revenue"]}],
}


@pytest.fixture(scope="module")
def mappings(spark):
    """Three mapping rows per dataset, unfolded from one row each, as the planner takes them for a small table."""
    return spark.range(4).select(F.col("id").alias("dataset_id"), F.explode(F.array(*map(F.lit, COLUMNS))).alias("name")).withColumns({
        "role": F.when(F.col("name") == "revenue", "measure_column").when(F.col("name") == "order_date", "date_time").otherwise("identifier"),
        "detected_type": F.when(F.col("name") == "revenue", "decimal").when(F.col("name") == "order_date", "date").otherwise("string"),
    })


def payloads(spark, document, *names):
    return spark.createDataFrame([(i, json.dumps(document)) for i in range(3)], "dataset_id long, payload string").select(
        *(F.col("dataset_id").alias(n) for n in names), "dataset_id", "payload"
    )


def unfolded_is_shuffled(df):
    return "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_proposals_meet_unfolded_mappings_by_a_shuffle(spark, mappings):
    proposals = payloads(spark, SPEC, "proposal_id")
    unknown = P.unknown_columns(P.parse(proposals), mappings)
    found = P.violations(proposals, M.column_sets(mappings))
    assert unfolded_is_shuffled(unknown) and unfolded_is_shuffled(found)
    assert sorted(map(tuple, unknown.collect())) == [(i, "dim_order", "colour") for i in range(3)]
    assert sorted((r.proposal_id, r.rule) for r in found.collect()) == [(i, "dimension_unknown_columns") for i in range(3)]


def test_suggestions_meet_unfolded_columns_by_a_shuffle(spark, mappings):
    item = {"raw_column_name": "order_id", "suggested_name": "order_no", "semantic_role": "identifier", "confidence": 0.5, "reason": "Unique"}
    asked = payloads(spark, {"columns": [item, {**item, "raw_column_name": "colour"}]})
    rows = M.review_suggestions(asked, mappings.select("dataset_id", F.col("name").alias("raw_column_name")))
    assert unfolded_is_shuffled(rows)
    assert sorted((r.dataset_id, r.position, r.violations) for r in rows.collect()) == [
        (i, k, v) for i in range(3) for k, v in ((0, ""), (1, "unknown_column"))
    ]


def test_questions_meet_catalogs_by_a_shuffle(spark):
    asked = payloads(spark, {"suggested_questions": [{"question": "Which shelf sold most?"}]}, "payload_id")
    terms = spark.range(1).select(F.col("id").alias("dataset_id"), F.explode(F.array(F.lit("shelf"), F.lit("sold"))).alias("term"))
    rows = Z.screen_questions(asked, ["revenue"], terms, ["dataset_id"])
    assert unfolded_is_shuffled(rows)
    assert sorted((r.payload_id, r.violations) for r in rows.collect()) == [(0, ""), (1, "no_catalog_term"), (2, "no_catalog_term")]


def test_datasets_meet_unfolded_mappings_by_a_shuffle(spark, sf_dir):
    from martloom.registry import modelling

    assert unfolded_is_shuffled(modelling.REG.queries["transformable_datasets"](spark, sf_dir))
    assert unfolded_is_shuffled(unbroadcast(spark.range(3)).join(spark.range(2), "id"))


def test_members_of_many_groups_take_room_by_their_number(spark):
    """Each of 200 groups has three members far apart."""
    facts = spark.range(600).select(
        F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("key"), (F.col("id") % 200).alias("shop"), (F.col("id") % 2).alias("area")
    )
    facts = facts.union(facts.limit(50)).union(spark.sql("select null, 7L, 1L"))
    found = distinct_counts.members(facts, ["area", "shop"], "key", distinct_counts.dictionary(facts, "key"))
    room = sum(len(r.bits) if isinstance(r.bits, (bytes, bytearray)) else 8 for r in found.collect())
    assert room <= 8 * 600
    for by, want in (([], [(600,)]), (["area"], [(0, 300), (1, 300)]), (["shop"], [(s, 3) for s in range(200)])):
        assert sorted(map(tuple, distinct_counts.counted(found, by).collect())) == want


def joined_columns(df):
    """The columns that go into the joins of a plan."""
    found = set()

    def walk(node):
        children = [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            found.update(c.output().apply(k).name() for c in children for k in range(c.output().size()))
        for c in children:
            walk(c)

    walk(df._jdf.queryExecution().optimizedPlan())
    return found


def test_insights_meet_charts_without_their_texts(spark):
    insight = {"summary": "up", "key_findings": ["it proves that"], "tags": ["trend", "trend"], "confidence": "low"}
    document = {"question_insight": insight, "chart_insights": [{**insight, "chart_title": "Sales"}, {**insight, "chart_id": "gone"}]}
    charts = spark.createDataFrame([(1, "z", "SALES", 1)], "run_id long, chart_id string, title string, sort_order int")
    rows = Z.screen_insights(payloads(spark, document, "run_id"), charts)
    assert not joined_columns(rows) & {"payload", "doc", "summary", "findings", "i"}
    got = sorted((r.run_id, r.position, r.violations, r.chart_id) for r in rows.filter("run_id = 1").collect())
    assert got == [(1, 0, "finding_claim", None), (1, 1, "finding_claim", "z"), (1, 2, "unknown_chart|finding_claim", None)]
    assert [r.violations for r in rows.filter("run_id = 2 and position = 1").collect()] == ["unknown_chart|finding_claim"]


def test_plans_are_dealt_out_before_they_are_parsed(spark):
    from martloom.operators import plan_checks as Q
    from martloom.plans.retail import RETAIL_CATALOG
    from martloom.sources.inline import catalog

    plans = spark.createDataFrame([(i, json.dumps({"question": "q"})) for i in range(40)], "plan_id long, payload string").coalesce(1)
    checked = Q.checked(plans, catalog(spark, RETAIL_CATALOG))
    # So few rows are put together again at run time, but by a shuffle of the texts below the parser.
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("parseJson(") < plan.index("RepartitionByExpression [plan_id")
    assert {tuple(r.broken) for r in checked.collect()} and checked.count() == 40


def test_a_batch_checks_its_plans_once(spark, sf_dir, monkeypatch):
    from martloom.plans import batch
    from martloom.registry import analysis

    copies, keep = [], batch.kept

    def counted(plans):
        copies.append(keep(plans))
        return copies[-1]

    monkeypatch.setattr(batch, "kept", counted)
    found = analysis.REG.queries["plan_batch"](spark, sf_dir)
    assert len(copies) == 2 and "try_parse_json" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "VariantExpressionEvalUtils" not in found._jdf.queryExecution().optimizedPlan().toString()
