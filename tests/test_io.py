"""Readers and sinks (S8, S11-S19) and the day-partitioned usage log."""

import json
import os
import tempfile
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from metercast.operators import usage as U
from metercast.sources import readers as RD
from metercast.sources import sinks as SK


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="metercast-io-"), name)


def _metering(spark):
    rows = [(datetime(2024, 1, d, h), "AI_SERVICES", 0.25 * d) for d in range(1, 31) for h in (3, 15)]
    rows += [(datetime(2024, 1, 30, 12), "WAREHOUSE_METERING", 100.0)]
    return spark.createDataFrame(rows, RD.SCHEMAS["metering"])


def test_partitioned_log_prunes_days_and_keeps_results(spark):
    path = _tmp("metering")
    SK.write_usage_log(_metering(spark), path)
    back = RD.read_usage(spark, path, "metering")
    assert "log_date" in back.columns and "credits_used_e8" in back.columns
    q = U.usage_overview(back, "2024-01-30 23:59:59", days=7)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "log_date#" in plan
    direct = U.usage_overview(_metering(spark), "2024-01-30 23:59:59", days=7).first()
    assert q.first().total_credits == pytest.approx(direct.total_credits)
    # days 24..30 inclusive (>= 23 Jan 23:59:59), two rows per day
    assert direct.total_credits == pytest.approx(sum(0.25 * d * 2 for d in range(24, 31)))


def test_read_usage_declared_schema_and_decimal_normalized(spark):
    path = _tmp("analyst")
    spark.createDataFrame([(datetime(2024, 1, 1), Decimal("1.23456789"))],
                          "start_time timestamp_ntz, credits decimal(20,8)").write.parquet(path)
    df = RD.read_usage(spark, path, "analyst")
    assert dict(df.dtypes) == {"start_time": "timestamp_ntz", "credits": "double",
                               "credits_e8": "bigint"}
    assert df.first().credits_e8 == 123456789


def test_read_usage_tolerant_missing_path(spark):
    df, ok = RD.read_usage_tolerant(spark, _tmp("nope"), "search")
    assert not ok and df.count() == 0 and "credits_e8" in df.columns
    with pytest.raises(ValueError):
        RD.read_usage(spark, _tmp("x"), "unknown_kind")


def test_text_columns_and_fallback(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id long, body string, v double")
    assert RD.text_columns(df) == ["body"]
    nums = spark.createDataFrame([(1, 2.0)], "id long, v double")
    assert RD.text_columns(nums) == ["id", "v"]


def test_preview_count_and_text_source(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"t{i}") for i in range(20)],
                               "id long, text string")
    assert RD.count_non_null(df, "text").first().row_count == 13
    assert RD.preview(df, "text", 5).count() == 5
    assert RD.text_source(df, "text", key="id").where(F.col("text").isNull()).count() == 0


def test_list_sources_and_check_access(spark):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("metercast_probe")
    spark.createDataFrame([], "x int").createOrReplaceTempView("metercast_empty")
    tables = {r.table for r in RD.list_sources(spark).collect()}
    assert "metercast_probe" in tables
    assert RD.check_access(spark, "metercast_probe")
    assert not RD.check_access(spark, "metercast_empty")
    assert not RD.check_access(spark, "metercast_missing_table")


def test_cached_releases(spark):
    df = spark.range(10)
    with RD.cached(df) as c:
        assert c.count() == 10 and c.is_cached
    assert not df.is_cached


def _results(spark):
    return spark.createDataFrame(
        [("t1", "m1", "COMPLETE", 0.02, 0.5, "success"), ("t1", "m2", "COMPLETE", 0.01, 0.9, "success"),
         ("t2", "m3", "SENTIMENT", 0.0, 0.1, "error"), ("t2", "m1", "SENTIMENT", 0.03, 0.2, "success")],
        "test string, model string, function string, cost double, latency double, status string")


def test_summary_json_and_csv_sinks(spark):
    res = _results(spark)
    path = _tmp("summary")
    SK.write_summary(res, path)
    files = [f for f in os.listdir(path) if f.endswith(".json")]
    doc = json.loads(open(os.path.join(path, files[0])).read().strip())
    assert doc == {"tests": 2, "results": 3, "cheapest": {"model": "m2", "cost": 0.01},
                   "fastest": {"model": "m1", "latency": 0.2}}
    csv = _tmp("csv")
    SK.write_csv(res, csv)
    back = spark.read.option("header", True).csv(csv)
    assert back.count() == 4 and back.columns == res.columns


def test_tune_for_input_bounds(spark):
    from metercast.session import tune_for_input
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
                                          "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        assert tune_for_input(spark, 100 * 10**12) == 745_059      # 100 TB / 128 MiB, no cap
        assert tune_for_input(spark, 10**12) == 7451               # 1 TB / 128 MiB, rounded up
        assert tune_for_input(spark, 10**6) == 200
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(256 << 20)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_usage_log_reload_replaces_only_its_days(spark):
    path = _tmp("reload")
    met = _metering(spark)
    SK.write_usage_log(met, path)
    jan2 = met.where(F.to_date("start_time") == F.lit("2024-01-02").cast("date"))
    SK.write_usage_log(jan2, path)          # the same day loaded again
    SK.write_usage_log(jan2, path)
    back = RD.read_usage(spark, path, "metering")
    assert back.count() == met.count()


def test_bucketed_usage_and_history_join_without_shuffle(spark):
    from metercast.sources.testdata import AS_OF_ORDERS, TestData
    from .conftest import SF_SMALL
    t = TestData(spark, SF_SMALL)
    usage = t.usage().select("query_id", "function_name", "model_name", "tokens", "token_credits",
                             "token_credits_e8")
    qh = t.query_history(users=False)
    SK.write_bucketed(usage, "mc_usage_b", "query_id", 8, path=_tmp("usage_b"))
    SK.write_bucketed(qh, "mc_qh_b", "query_id", 8, path=_tmp("qh_b"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = U.model_analysis(spark.table("mc_usage_b"), spark.table("mc_qh_b"), AS_OF_ORDERS, 90)
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert "Exchange hashpartitioning(query_id" not in plan     # co-located buckets
        want = U.model_analysis(usage, qh, AS_OF_ORDERS, 90).collect()
        assert sorted(map(tuple, b.collect())) == sorted(map(tuple, want))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS mc_usage_b")
        spark.sql("DROP TABLE IF EXISTS mc_qh_b")


def test_normalize_numeric_only_touches_decimals(spark):
    df = spark.createDataFrame([(Decimal("1.50"), 2, "x")], "a decimal(10,2), b int, c string")
    assert RD.normalize_numeric(df).dtypes == [("a", "double"), ("b", "int"), ("c", "string")]
