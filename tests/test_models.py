"""Model building, plans and the operators that have to survive skew."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from martloom.operators import cards as K
from martloom.operators import mapping as M
from martloom.operators import plan_checks as Q
from martloom.operators import proposals as O
from martloom.operators import sequences as S
from martloom.plans import retail as R
from martloom.plans import spec as P
from martloom.plans.analysis import AnalysisPlan, Filter, run_plan
from martloom.sources.inline import catalog

RETAIL_ROWS = [
    # order_id, line, date, customer, name, segment, product, p_name, category, store, s_name, region, qty, price, disc, revenue, cost, pay
    ("O1", "L1", "2026-01-05", "C1", "Ann", "Home", "P1", "Ring", "Small", "S1", "North", "EU", "2", "10.00", "1.50", "", "5", "Cash"),
    ("O1", "L2", "2026-01-05", "C1", "Ann", "Home", "P1", "Ring XL", "Small", "S1", "North", "EU", "1", "10.00", "", "9.999", "4", "Cash"),
    ("O2", "L3", "02/03/2026", " ", "", "", "P2", "Bolt", "Large", "S1", "North", "EU", "x", "3", "", "7", "", "Card"),
]


@pytest.fixture(scope="module")
def retail(spark):
    return R.RetailModel(spark.createDataFrame(RETAIL_ROWS, ", ".join(f"{c} string" for c in R.STAGING_ORDER)))


def test_revenue_falls_back_to_arithmetic(retail):
    rows = {r["order_line_id"]: r for r in retail.model("fact_sales").collect()}
    assert float(rows["L1"]["net_revenue"]) == 18.5 and float(rows["L1"]["gross_margin"]) == 13.5
    assert float(rows["L2"]["net_revenue"]) == 10.0
    assert rows["L3"]["quantity"] is None and str(rows["L3"]["order_month"]) == "2026-02-01"
    assert rows["L3"]["customer_id"] is None


def test_changed_attributes_fan_out_the_product_mart(retail):
    """Two variants of P1: both of its lines count once under each name."""
    rows = {r["product_name"]: float(r["revenue"]) for r in retail.model("mart_product_performance").collect()}
    assert rows == {"Ring": 28.5, "Ring XL": 28.5, "Bolt": 7.0}


def test_missing_keys_stay_in_the_segment_mart(retail):
    rows = {r["customer_segment"]: r for r in retail.model("mart_customer_segments").collect()}
    assert set(rows) == {"Home", None}
    assert rows["Home"]["orders"] == 1 and rows["Home"]["average_order_value"] == 28.5


def test_written_layers_equal_lazy_layers(spark, retail, tmp_path):
    from martloom.sources.sinks import parquet_writer

    written = R.RetailModel(retail.raw).write(parquet_writer(str(tmp_path), {"fact_sales": "order_month"}))
    for name in ("fact_sales", "mart_store_performance", "dim_date"):
        assert sorted(map(str, written[name].collect())) == sorted(map(str, retail.model(name).collect()))


def test_layers_can_be_saved_as_catalog_tables(spark, retail):
    from martloom.sources.sinks import table_writer

    R.RetailModel(retail.raw).write(table_writer({"fact_sales": "order_month"}))
    for layer in R.RetailModel.LAYERS.values():
        for name in layer:
            assert sorted(map(str, spark.table(name).select(*retail.model(name).columns).collect())) == sorted(
                map(str, retail.model(name).collect())
            )
            spark.sql(f"DROP TABLE {name}")


def test_detected_number_beats_dimension_role(spark):
    """An integer-looking label, such as a postcode, is routed to a number."""
    zip_code = P.Mapping("zip", "zip", "dimension", "integer")
    assert zip_code.kind == "number"
    df = spark.createDataFrame([("dimension", "integer"), ("dimension", "string"), ("date_time", "string")], "r string, t string")
    assert [r[0] for r in df.select(P.route_kind(F.col("r"), F.col("t"))).collect()] == ["number", "text", "date"]


def test_spec_mart_joins_only_what_the_fact_lacks(spark):
    raw = spark.createDataFrame(
        [("1", "c1", "n1", "eu", "10", "2026-01-01"), ("2", "c1", "n2", "eu", "5", "2026-02-01"), ("3", None, "n3", "us", "2", "bad")],
        "id string, cust string, name string, region string, amount string, day string",
    )
    mappings = [
        P.Mapping("id", "line_id", "identifier"), P.Mapping("cust", "customer_id", "identifier"),
        P.Mapping("name", "customer_name", "dimension"), P.Mapping("region", "region", "dimension"),
        P.Mapping("amount", "amount", "measure_column"), P.Mapping("day", "day", "date_time"),
    ]
    spec = P.ModelSpec(
        "fact_x", ("line_id",), ("amount",), ("day",), (P.Dimension("dim_customer", "customer_id", ("customer_id", "customer_name", "region")),),
        (P.Mart("mart_a", "", ("day_month", "customer_name"), ("amount",)), P.Mart("mart_b", "", ("day_month",), ("amount",))),
    )
    models = P.build_models(raw, mappings, spec)
    assert spec.fact_columns() == ["line_id", "customer_id", "day", "day_month", "amount"]
    got = {(str(r[0]), r[1]): float(r[2]) for r in models["mart_a"].collect()}
    assert got == {
        ("2026-01-01", "n1"): 10.0, ("2026-01-01", "n2"): 10.0, ("2026-02-01", "n1"): 5.0, ("2026-02-01", "n2"): 5.0, ("None", None): 2.0,
    }
    assert "Join" not in models["mart_b"]._jdf.queryExecution().optimizedPlan().toString()


def test_plan_filters_are_three_valued_and_only_stated_limits_hold(spark):
    mart = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 4.0)], "d string, m double")
    run = lambda **kw: [tuple(r) for r in run_plan(mart, AnalysisPlan("x", (("m", "sum"),), **kw)).collect()]
    assert run(filters=(Filter("d", "!=", "a"),)) == [(2.0,)]
    assert run(dimensions=("d",), filters=(Filter("d", "=", None),)) == []
    assert run(dimensions=("d",), sort=(("d", "asc"),)) == [("a", 1.0), ("b", 2.0), (None, 4.0)]
    assert run(dimensions=("d",), sort=(("d", "desc"),), limit=1) == [(None, 4.0)]
    many = spark.range(1200).select("id", F.lit(1).alias("m"))
    assert run_plan(many, AnalysisPlan("x", (("m", "sum"),), ("id",))).count() == 1200
    first = run_plan(many, AnalysisPlan("x", (("m", "sum"),), ("id",), sort=(("m", "asc"),), limit=3)).collect()
    assert [r["id"] for r in first] == [0, 1, 2]


def test_an_oversized_quantity_ends_no_job(spark):
    from martloom.functions import cleaning as C

    huge = "9" * 38
    df = spark.createDataFrame([(huge, "2.50"), (huge, "3.00"), ("2", "1.50")], "q string, p string")
    typed = df.select(C.clean_whole_number(F.col("q")).alias("quantity"), C.clean_money(F.col("p")).alias("price"))
    none = F.lit(None).cast("decimal(18,2)")
    net = typed.select("quantity", C.net_revenue(none, F.col("quantity"), F.col("price"), none).alias("net"))
    assert [None if r["net"] is None else float(r["net"]) for r in net.collect()] == [None, None, 3.0]
    assert run_plan(net, AnalysisPlan("x", (("quantity", "sum"), ("net", "sum")))).first()["quantity"] is None


def test_previous_value_across_slices_matches_brute_force(spark):
    """One key holds most rows, so its run of rows spans several slices."""
    rows = [("hot" if i % 10 else f"k{i % 7}", (i * 7919) % 1000, i, f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v string").repartition(5)
    got = {r["id"]: r["prev"] for r in S.with_previous(df, ["k"], ["t", "id"], "v", "prev", F.floor(F.col("t") / 50)).collect()}
    want, last = {}, defaultdict(lambda: None)
    for k, _, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i], last[k] = last[k], v
    assert got == want


def test_snapshot_children_stay_rows(spark):
    runs = spark.sql("select 1L as run_id, 1L as dataset_id, 'q' as question, 'completed' as status, 'm' as source_model, 1L as row_count, timestamp'2026-01-01' as completed_at union all select 2L, null, 'q', 'failed', 'm', 0L, null")
    datasets = spark.sql("select 1L as dataset_id, 'd' as dataset_name, 'upload' as source_type, 'ready_for_analysis' as status, cast(null as string) as deleted_at")
    charts = spark.range(500).select(F.lit(1).cast("long").alias("run_id"), F.concat(F.lit("c"), "id").alias("chart_id"), F.lit("bar").alias("chart_type"), F.col("id").alias("sort_order"))
    insights = charts.limit(0).select("run_id", F.col("chart_id").alias("insight_id"), F.lit("chart").alias("insight_level"), F.lit("x").alias("status"), "sort_order")
    attempts = spark.sql("select 1L as run_id, 9L as attempt_id, timestamp'2026-01-01' as created_at, 'analysis_plan' as task_type, 'a' as lane, 'completed' as status union all select 1L, 10L, timestamp'2026-01-01', 'semantic_preparation', 'a', 'completed'")
    heads = {r["run_id"]: r["card_snapshot"] for r in K.snapshot_headers(runs, datasets).collect()}
    assert heads[1]["dataset"]["name"] == "d" and not heads[1]["dataset"]["deleted"] and heads[2]["dataset"]["deleted"]
    children = K.snapshot_children(charts, insights, attempts).collect()
    assert sum(c["kind"] == "chart" for c in children) == 500 and [c["id"] for c in children if c["kind"] == "provider_run"] == ["9"]


MAPPED = [("order_id", "identifier", "identifier"), ("order_date", "date_time", "date"), ("customer_id", "identifier", "identifier"),
          ("customer_name", "dimension", "string"), ("revenue", "measure_column", "decimal"), ("channel", "dimension", "string")]


@pytest.fixture(scope="module")
def sets(spark):
    df = spark.createDataFrame([(1, i, n, r, t) for i, (n, r, t) in enumerate(MAPPED)], "dataset_id long, column_index long, name string, role string, detected_type string")
    return M.column_sets(df)


STAR = """{"grain": "one row per order", "fact_table": {"name": "fact_sales", "keys": ["order_id"], "measures": ["revenue"], "date_columns": ["order_date"]},
 "dimensions": [{"name": "dim_customer", "key_column": "customer_id", "columns": ["customer_name"]}],
 "marts": [{"name": "mart_monthly", "dimensions": ["order_date_month", "channel"], "metrics": [%s]}]}"""


def payloads(spark, *texts):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "proposal_id long, dataset_id long, payload string")


def test_star_schema_is_accepted_and_derives_its_fact(spark, sets):
    specs = O.accepted(payloads(spark, STAR % '"revenue"'), sets)
    row = O.derived(specs).collect()[0]
    assert row["fact_columns"] == ["order_id", "customer_id", "channel", "order_date", "order_date_month", "revenue"]
    assert O.catalog(specs).collect()[0]["grain"] == "one row per mart grouping"
    assert specs.collect()[0]["dimensions"][0]["columns"] == ["customer_id", "customer_name"]


def test_violations_come_in_checking_order(spark, sets):
    bad = STAR.replace('"fact_sales"', '"sales"') % '"profit"'
    found = O.violations(payloads(spark, bad, "nope", '{"grain": "my password"}', STAR.replace('"one row per order"', "7") % '"revenue"'), sets).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["proposal_id"], r["position"])):
        got[r["proposal_id"]].append((r["position"], r["rule"], r["subject"]))
    assert got[0] == [(0, "fact_name", ""), (1, "mart_metric_not_in_fact", "mart_monthly")]
    assert got[1] == [(0, "not_json_object", "")] and got[2] == [(0, "secret_text", "")]
    assert [r for _, r, _ in got[3]] == ["grain_text", "fact_grain"]


PLAN = '{"decision_type": "create_new", "question": "Revenue?", "source_model": "mart_a", "metrics": [{"name": "m", "aggregation": "SUM"}], "dimensions": ["d", "d"], "filters": [{"field": "d", "operator": "!=", "value": %s}], "sort": [{"field": "m", "direction": "desc"}], "limit": %s}'


def test_accepted_plan_runs(spark):
    marts = {"mart_a": {"grain": "one row per d", "dimensions": ["d"], "metrics": ["m", "n"]}}
    plans = spark.createDataFrame(
        [(1, PLAN % ('"a"', "9999")), (2, PLAN % ('[1]', '"5"')), (3, (PLAN % ("null", "2")).replace('"field": "m"', '"field": "n"'))],
        "plan_id long, payload string",
    )
    found = {(r["plan_id"], r["rule"]) for r in Q.violations(plans, catalog(spark, marts)).collect()}
    assert found == {(1, "limit_range"), (2, "filter_value"), (2, "limit_integer"), (3, "sort_not_selected")}
    plans = spark.createDataFrame([(1, PLAN % ('"a"', "500"))], "plan_id long, payload string")
    row = Q.accepted(plans, catalog(spark, marts)).collect()[0]
    plan = Q.to_plan(row)
    assert plan == AnalysisPlan("mart_a", (("m", "sum"),), ("d",), (Filter("d", "!=", "a"),), (("m", "desc"),), 500)
    mart = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("b", 4.0)], "d string, m double")
    assert [tuple(r) for r in run_plan(mart, plan).collect()] == [("b", 6.0), ("c", 3.0)]


def test_edits_with_a_bad_name_change_nothing(spark):
    mappings = spark.createDataFrame([(1, 0, "a", "dimension", 0.9, None, None, True), (2, 0, "a", "dimension", 0.9, None, None, True)],
        "dataset_id long, column_index long, suggested_name string, semantic_role string, confidence double, approved_name string, approved_role string, include_in_model boolean")
    edits = spark.createDataFrame([(1, 0, "b", "dimension", False), (1, 1, "new", "unknown", True), (2, 0, "ok", "dimension", True), (2, 1, "not ok", "dimension", True)],
        "dataset_id long, column_index long, approved_name string, approved_role string, include_in_model boolean")
    rows = {(r["dataset_id"], r["column_index"]): r for r in M.apply_edits(mappings, edits).collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0)}
    assert rows[1, 0]["approved_name"] == "b" and rows[1, 0]["include_in_model"] is False and rows[1, 0]["user_edited"]
    assert rows[1, 1]["confidence"] == 0.0 and rows[1, 1]["suggested_name"] == "new"
    assert rows[2, 0]["approved_name"] is None and not rows[2, 0]["user_edited"]


def test_long_lists_are_judged_to_the_end(spark, sets):
    dims = ", ".join(f'{{"name": "dim_{k}", "key_column": "customer_id", "columns": ["customer_id"]}}' for k in range(6))
    long = (STAR % '"revenue"').replace('"dimensions": [{"name": "dim_customer"', f'"dimensions": [{dims}, {{"name": "wrong"')
    found = {(r["rule"], r["subject"], r["within_limit"]) for r in O.violations(payloads(spark, long), sets).collect()}
    assert found == {("dimension_name", "wrong", False), ("list_too_long", "dimensions", False)}


def test_an_accepted_proposal_becomes_models(spark, sets):
    row = O.accepted(payloads(spark, STAR % '"revenue"'), sets).first()
    spec = P.to_spec(row)
    assert spec.fact_columns() == ["order_id", "customer_id", "channel", "order_date", "order_date_month", "revenue"]
    assert spec.marts[0].dimensions == ("order_date_month", "channel") and spec.degenerate == ("channel",)


QUESTIONS = """{"suggested_questions": [{"question": "Raw cost of sales?"}, {"question": "Sales trend?", "intent": "two words"},
 {"question": "sales TREND?", "intent": "trend"}, {"question": "Sales trend?"}, {"question": 5}, {"question": "raw cost?", "intent": true}]}"""


def test_every_question_is_judged_and_the_first_good_spelling_kept(spark):
    from martloom.operators import screening as Z

    df = spark.createDataFrame([("p", QUESTIONS)], "payload_id string, payload string")
    rows = sorted(Z.screen_questions(df, ["sales"]).collect(), key=lambda r: r["position"])
    assert [r["kept"] for r in rows] == [False, False, True, False, False, False]
    assert [r["within_limit"] for r in rows] == [True] * 5 + [False]
    assert rows[5]["violations"] == "raw_only_term|no_catalog_term|intent" and rows[4]["violations"] == "text"


INSIGHT = """{"question_insight": {"summary": 5, "key_findings": "all customers", "tags": "trend", "confidence": "low"}, "chart_insights": [
 {"chart_title": "Sales", "summary": "up", "key_findings": ["a", "b", "c", "d", "e", "this proves that"], "confidence": "low"},
 {"chart_title": "Sales", "summary": "up", "tags": ["a tag that is longer than thirty-two letters"], "confidence": "low"}]}"""


def test_insight_members_of_the_wrong_type_are_reported(spark):
    from martloom.operators import screening as Z

    df = spark.createDataFrame([(1, INSIGHT)], "run_id long, payload string")
    charts = spark.createDataFrame([(1, "z", "Sales", 1), (1, "a", "SALES", 2)], "run_id long, chart_id string, title string, sort_order int")
    rows = sorted(Z.screen_insights(df, charts).collect(), key=lambda r: r["position"])
    assert rows[0]["violations"] == "summary_text|findings_list|tags_list"
    assert rows[1]["violations"] == "finding_claim" and not rows[1]["finding_within_limit"] and rows[1]["chart_id"] == "a"
    assert rows[2]["violations"] == "tag"
