"""A hot key: one query id carries a third of all usage rows. The usage ⋈
history join must split it (adaptive skew join) and stay exact."""

from datetime import datetime

import pandas as pd
import pytest

from metercast.operators import usage as U

_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_query_id_is_split_and_exact(spark, skew_conf):
    n_hot, n_rest, n_ids = 12000, 24000, 2000
    models = ["llama3.1-8b", "mistral-large2", "", "claude-4-opus"]
    fns = ["COMPLETE", "SENTIMENT", "TRANSLATE"]
    rows = [(1, fns[i % 3], models[i % 4], 100 + i % 7, 1.0 + (i % 5) / 100) for i in range(n_hot)]
    rows += [(2 + i % n_ids, fns[i % 3], models[(i // 3) % 4], 50 + i % 11, 0.5 + (i % 3) / 100)
             for i in range(n_rest)]
    usage = spark.createDataFrame(rows, "query_id long, function_name string, model_name string, "
                                        "tokens long, token_credits double")
    qh = spark.createDataFrame([(q, datetime(2024, 1, 10)) for q in range(1, n_ids + 2)],
                               "query_id long, start_time timestamp_ntz")
    out = U.model_analysis(usage, qh, "2024-01-30 00:00:00", 30)
    got = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "skew=true" in plan

    pdf = pd.DataFrame(rows, columns=["query_id", "function_name", "model_name", "tokens", "token_credits"])
    pdf["model_name"] = pdf["model_name"].replace("", "Specialized Function")
    pdf["e8"] = (pdf["token_credits"] * 1e8).round().astype("int64")
    want = pdf.groupby(["model_name", "function_name"]).agg(
        invocations=("tokens", "size"), total_tokens=("tokens", "sum"), e8=("e8", "sum")).reset_index()
    assert len(got) == len(want)
    w = {(r.model_name, r.function_name): r for r in want.itertuples()}
    for r in got:
        e = w[(r.model_name, r.function_name)]
        assert (r.invocations, r.total_tokens) == (e.invocations, e.total_tokens)
        assert r.total_credits == e.e8 / 1e8


_BLOOM_CONF = {
    # stand-in for 100 TB: the usage scan counts as large and the joins shuffle
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


def test_history_window_reaches_the_usage_scan_as_a_bloom_filter(spark):
    """At scale the look-back window on the history side must cut the usage
    rows before they are shuffled: the optimizer injects a runtime bloom
    filter of the windowed query ids into the usage scan. Results do not
    change."""
    from metercast.sources.testdata import AS_OF_ORDERS, TestData

    from .conftest import SF_SMALL
    t = TestData(spark, SF_SMALL)
    q = lambda: U.usage_by_function(t.usage(), t.query_history(users=False), AS_OF_ORDERS, 30)
    want = sorted(q().collect())
    old = {k: spark.conf.get(k, None) for k in _BLOOM_CONF}
    try:
        for k, v in _BLOOM_CONF.items():
            spark.conf.set(k, v)
        out = q()
        got = sorted(out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == want
    usage_scan = [ln for ln in plan.splitlines() if "might_contain" in ln]
    assert usage_scan and "l_orderkey" in usage_scan[0]


def test_listings_cut_one_hot_instant_over_several_ranges(spark):
    """A third of all rows at one time: the other columns order them, so that they are no single sort range."""
    from pyspark.sql import functions as F
    from metercast.operators import usage
    rows = spark.range(30_000).select(
        F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, if(id % 3 = 0, 0, id))").alias("start_time"),
        (F.col("id") / 7.0).alias("credits"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = usage.analyst_usage(rows, "2024-03-02 00:00:00", 30).withColumn("_p", F.spark_partition_id())
        hot = out.where("start_time = timestamp_ntz'2024-03-01 00:00:00'").select("_p").distinct().count()
        times = [r.start_time for r in out.select("start_time").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert hot > 1 and times == sorted(times, reverse=True)
