"""Edge cases: empty inputs, missing sources, everything
filtered out, k above the catalog size."""

from datetime import datetime

import pytest

from metercast.operators import budget as B
from metercast.operators import catalog_ops as CO
from metercast.operators import costing as C
from metercast.operators import forecast as FC
from metercast.operators import reconcile as R
from metercast.operators import runs as RU
from metercast.sources import catalog as cat

_MET = "start_time timestamp_ntz, service_type string, credits_used double"


def test_empty_inputs_give_empty_or_zero(spark, catalog):
    daily = spark.createDataFrame([], "usage_date date, credits double")
    assert FC.forecast(daily).count() == 0
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.cheapest_model_per_request(conv, catalog).count() == 0
    assert C.estimate_request_cost(conv, catalog).count() == 22      # one global row x models
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert C.estimate_text_cost(docs, "text", catalog).count() == 0
    assert C.estimate_by_test_type(docs, "text", catalog).count() == 0
    tasks = spark.createDataFrame([], "task string")
    assert CO.models_for_task(tasks, catalog, cat.load_task_keywords(spark)).count() == 0
    res = spark.createDataFrame([], "test string, model string, function string, cost double, "
                                    "latency double, status string, response string")
    assert RU.compare_all(res).first().total_runs == 0


def test_budget_without_usage_is_green(spark):
    met = spark.createDataFrame([], _MET)
    limits = spark.createDataFrame([("daily", 10.0, True), ("monthly", 0.0, True)],
                                   "period string, `limit` double, enabled boolean")
    rows = {r.period: r for r in B.budget_status(met, limits, "2024-01-30 12:00:00").collect()}
    assert rows["daily"].used == 0.0 and rows["daily"].light == "green"
    assert rows["monthly"].pct == 0.0                   # zero limit: no division, 0 %
    assert B.active_alerts(B.budget_status(met, limits, "2024-01-30 12:00:00")).count() == 0


def test_reconcile_all_sources_missing(spark):
    met = spark.createDataFrame([(datetime(2024, 1, 29), "AI_SERVICES", 5.0)], _MET)

    def missing():
        return spark.read.parquet("/nonexistent/metercast/source")
    src = [R.SourceSpec(f"s{i}", missing, "credits") for i in range(3)]
    r = R.reconcile(met, src, "2024-01-30 00:00:00", 30).first()
    assert (r.granular_total, r.sources_missing, r.variance_pct, r.status) == (0.0, 3, -100.0, "CRITICAL")
    svc = R.reconcile_services(src, "2024-01-30 00:00:00", 30).collect()
    assert {s.status for s in svc} == {R.STATUS_NO_ACCESS}
    assert R.reconcile_services(src, "2024-01-30 00:00:00", 30, positive_only=True).count() == 0


def test_k_above_catalog_and_empty_allow_list(spark, catalog):
    conv = spark.createDataFrame([(1, 1, "user", "hello there"), (1, 2, "assistant", "hi")],
                                 "conv_id long, turn long, role string, text string")
    assert C.cheapest_k_per_request(conv, catalog, k=50).count() == 22
    work = spark.createDataFrame([(1, 10, 1, 5)], "work_id long, input_tokens_per_request long, "
                                                  "output_tokens_per_request long, requests long")
    assert C.cost_calculator(work, catalog, allowed=[]).count() == 0
    one = C.cost_calculator(work, catalog, allowed=["mistral-7b"]).first()
    assert one.cheapest_model == one.most_expensive_model == "mistral-7b" and one.savings_pct == 0.0


@pytest.mark.parametrize("fan_in", [1, 7, 1000])
def test_top_k_is_exact_whatever_the_fan_in(spark, fan_in):
    """``top_k`` merges in two levels: same rows as a full sort, ties broken by the key."""
    from pyspark.sql import functions as F

    from metercast.operators.common import top_k
    df = spark.range(0, 5000, numPartitions=40).select(
        F.col("id"), (F.col("id") * 7919 % 101).alias("v"))
    out = top_k(df, [F.desc_nulls_last("v"), F.col("id")], 37, fan_in=fan_in)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # the first one below the shuffle
    got = [(r.id, r.v) for r in out.collect()]
    want = sorted(((i, i * 7919 % 101) for i in range(5000)), key=lambda t: (-t[1], t[0]))[:37]
    assert got == want
