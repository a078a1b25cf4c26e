"""Bands, budgets, forecast, reconciliation and opportunity rules on small
literal frames (E13, E14, C8, C10, C11, C13, C14) plus roll-up properties."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from metercast.functions import bands
from metercast.operators import budget as B
from metercast.operators import forecast as FC
from metercast.operators import optimize as O
from metercast.operators import reconcile as R
from metercast.operators import usage as U
from metercast.sources.testdata import AS_OF_ORDERS, TestData

from .conftest import SF_SMALL


def test_variance_bands_at_edges(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (1.01,), (5.0,), (15.0,), (15.01,), (-40.0,)], "v double")
    got = [r.s for r in df.select(bands.variance_status("v").alias("s")).collect()]
    assert got == ["EXCELLENT", "EXCELLENT", "GOOD", "GOOD", "WARNING", "CRITICAL", "CRITICAL"]


def test_budget_lights_and_alerts(spark):
    metering = spark.createDataFrame(
        [(datetime(2024, 1, 30, 10), "AI_SERVICES", 8.0), (datetime(2024, 1, 29, 10), "AI_SERVICES", 2.0),
         (datetime(2024, 1, 2, 10), "AI_SERVICES", 40.0), (datetime(2023, 12, 31, 10), "AI_SERVICES", 999.0),
         (datetime(2024, 1, 30, 11), "WAREHOUSE_METERING", 500.0)],
        "start_time timestamp_ntz, service_type string, credits_used double")
    limits = spark.createDataFrame([("daily", 10.0, True), ("weekly", 10.0, True), ("monthly", 60.0, True),
                                    ("daily", 1.0, False)],
                                   "period string, `limit` double, enabled boolean")
    st = B.budget_status(metering, limits, "2024-01-30 23:59:59")
    rows = {(r.period, r.enabled): r for r in st.collect()}
    assert rows[("daily", True)].used == 8.0 and rows[("daily", True)].light == "yellow"
    assert rows[("weekly", True)].used == 10.0 and rows[("weekly", True)].pct == 100.0
    assert rows[("weekly", True)].light == "red"
    assert rows[("monthly", True)].used == 50.0 and rows[("monthly", True)].light == "yellow"
    assert rows[("daily", False)].pct == 0.0 and rows[("daily", False)].light == "green"
    # exactly 100 %: red, but no alert; disabled: no alert
    assert B.active_alerts(st).count() == 0


def test_forecast_negative_slope_and_single_day(spark):
    daily = spark.createDataFrame([(date(2024, 1, 1), 10.0), (date(2024, 1, 2), 6.0), (date(2024, 1, 3), 2.0)],
                                  "usage_date date, credits double")
    f = FC.forecast(daily, horizon=5).where(F.col("type") == "Forecast").orderBy("usage_date").collect()
    assert len(f) == 5
    assert [r.credits for r in f] == [2.0, 0.0, 0.0, 0.0, 0.0]
    assert f[0].usage_date == date(2024, 1, 4)
    one = spark.createDataFrame([(date(2024, 1, 1), 10.0)], "usage_date date, credits double")
    assert FC.forecast(one, horizon=30).count() == 0


def test_forecast_per_key_length(spark):
    daily = spark.createDataFrame([("a", date(2024, 1, d), float(d)) for d in range(1, 6)]
                                  + [("b", date(2024, 1, 1), 1.0)], "k string, usage_date date, credits double")
    out = FC.forecast(daily, keys=["k"], horizon=7)
    counts = {(r.k, r.type): r["count"] for r in out.groupBy("k", "type").count().collect()}
    assert counts == {("a", "Actual"): 5, ("a", "Forecast"): 7}


def _meter(spark, rows):
    return spark.createDataFrame(rows, "start_time timestamp_ntz, service_type string, credits_used double")


def test_reconcile_missing_source_and_zero_baseline(spark):
    m = _meter(spark, [(datetime(2024, 1, 20), "WAREHOUSE_METERING", 5.0)])
    facts = spark.createDataFrame([(datetime(2024, 1, 20), 2.0)], "start_time timestamp_ntz, credits double")
    sources = [R.SourceSpec("A", lambda: facts, "credits"),
               R.SourceSpec("Missing", lambda: spark.table("no_such_table_xyz"), "credits")]
    svc = {r.service: r for r in R.reconcile_services(sources, "2024-01-30 23:59:59", 30).collect()}
    assert svc["A"].credits == 2.0 and svc["A"].status == "OK"
    assert svc["Missing"].credits == 0.0 and svc["Missing"].status == "No Access"
    s = R.reconcile(m, sources, "2024-01-30 23:59:59", 30).collect()[0]
    assert s.baseline_credits == 0.0 and s.variance_pct == 0.0 and s.status == "EXCELLENT"
    assert s.baseline_missing and s.sources_missing == 1
    assert s.granular_total == 2.0


def test_reconcile_sum_of_services_equals_granular(spark):
    td = TestData(spark, SF_SMALL)
    from metercast.plans.metering_queries import service_sources
    src = service_sources(td)
    svc = R.reconcile_services(src, "2024-01-30 23:59:59", 30).agg(F.sum("credits")).collect()[0][0]
    s = R.reconcile(td.metering(), src, "2024-01-30 23:59:59", 30).collect()[0]
    assert svc == pytest.approx(s.granular_total)
    assert s.status == "GOOD"


def test_opportunity_rules(spark, catalog):
    usage = spark.createDataFrame(
        [(i, "SENTIMENT", "claude-4-opus", 1000, 0.0075) for i in range(3)]
        + [(100 + i, "COMPLETE", "llama3.1-70b", 100, 0.000029) for i in range(1001)]
        + [(5000, "COMPLETE", "claude-4-opus", 1000, 0.0075)]
        + [(5001, "SENTIMENT", "", 1000, 0.0016)],
        "query_id long, function_name string, model_name string, tokens long, token_credits double")
    qh = usage.select("query_id", F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz").alias("start_time"))
    opps = O.opportunities(usage, qh, catalog, "2024-01-30 00:00:00", 30).collect()
    by = {r.rule: r for r in opps}
    assert len(opps) == 2
    assert by[1].current == "claude-4-opus" and by[1].savings_pct == pytest.approx(99.6)
    assert by[2].current == "llama3.1-70b" and by[2].calls == 1001 and by[2].savings_pct == 80.0
    assert by[2].potential_savings == pytest.approx(by[2].current_credits * 0.8)


def test_rollups_equal_totals(spark):
    td = TestData(spark, SF_SMALL)
    g = U.model_function_groups(td.usage(), td.query_history(users=False), AS_OF_ORDERS, 3650)
    tot = U.rollup(g, []).collect()[0]
    by_model = U.rollup(g, ["model_name"]).agg(F.sum("invocations"), F.sum("total_credits")).collect()[0]
    by_fn = U.rollup(g, ["function_name"]).agg(F.sum("invocations")).collect()[0]
    assert by_model[0] == tot.total_invocations == by_fn[0]
    assert by_model[1] == pytest.approx(tot.total_credits)


def test_empty_usage_totals_are_zero(spark):
    empty = spark.createDataFrame([], "query_id long, function_name string, model_name string, "
                                      "tokens long, token_credits double")
    qh = spark.createDataFrame([], "query_id long, start_time timestamp_ntz")
    g = U.model_function_groups(empty, qh, AS_OF_ORDERS, 30)
    r = U.rollup(g, []).collect()[0]
    assert (r.total_invocations, r.total_tokens, r.total_credits, r.avg_tokens_per_call) == (0, 0, 0.0, 0.0)


def test_null_function_dropped_by_not_equal(spark):
    facts = spark.createDataFrame([(datetime(2024, 1, 20), None, 1.0), (datetime(2024, 1, 20), "COMPLETE", 2.0),
                                   (datetime(2024, 1, 20), "AI_EXTRACT", 4.0)],
                                  "start_time timestamp_ntz, function_name string, token_credits double")
    src = [R.SourceSpec("F", lambda: facts, "token_credits", where=lambda d: d.function_name != "AI_EXTRACT")]
    assert R.reconcile_services(src, "2024-01-30 00:00:00", 30).collect()[0].credits == 2.0


def test_grouping_set_levels_add_up(spark):
    from metercast.operators import usage as U
    from metercast.sources.testdata import AS_OF_ORDERS, TestData
    t = TestData(spark, SF_SMALL)
    rows = U.usage_rollups(t.usage(), t.query_history(users=False), AS_OF_ORDERS, 90).collect()
    by = {}
    for r in rows:
        by.setdefault(r.level, []).append(r)
    total = by["total"][0]
    for level in ("model_function", "model", "function"):
        assert sum(r.invocations for r in by[level]) == total.invocations
        assert sum(r.total_tokens for r in by[level]) == total.total_tokens
        assert abs(sum(r.total_credits for r in by[level]) - total.total_credits) < 1e-6
    assert all(r.function_name is None for r in by["model"])
