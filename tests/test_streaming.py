"""Budget monitor over a metering feed: the stream's final window states
equal the batch result on the same data; replays do not duplicate output."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from metercast.sources.testdata import AS_OF_EVENTS, TestData
from metercast.streaming import budget_monitor as BM

from .conftest import SF_SMALL


def _latest(alerts):
    keys = ["profile", "period", "limit", "enabled", "window_start", "window_end"]
    last = alerts.groupBy(*keys).agg(F.max(F.struct("batch_id", "used", "alert")).alias("s"))
    return {tuple(r[:6]): (round(r.s.used, 8), r.s.alert) for r in last.collect()}


def test_stream_matches_batch_and_alerts(spark):
    t = TestData(spark, SF_SMALL)
    met = t.metering().select("start_time", "service_type", "credits_used", "credits_used_e8")
    root = tempfile.mkdtemp(prefix="metercast-stream-")
    src = os.path.join(root, "feed")
    # time-ordered files, one append each, so the feed arrives in event order
    days = [r[0] for r in met.select(F.to_date("start_time")).distinct().orderBy(1).collect()]
    for i in range(0, len(days), 5):
        chunk = met.where(F.to_date("start_time").isin(days[i:i + 5]))
        chunk.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(met.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(root, "alerts")
    limits = t.limits()
    for period in ("daily", "weekly", "monthly"):
        q = BM.start_budget_monitor(stream, limits, out + "_" + period, period=period,
                                    checkpoint_location=os.path.join(root, "ckpt_" + period),
                                    trigger={"availableNow": True})
        q.awaitTermination(300)
        assert q.exception() is None
    got = {}
    for period in ("daily", "weekly", "monthly"):
        got.update(_latest(spark.read.parquet(out + "_" + period)))
    want = {tuple(r[:6]): (round(r.used, 8), r.alert)
            for r in BM.budget_windows(met, limits, periods=("daily", "weekly", "monthly"),
                                       watermark=None)
                      .select("profile", "period", "limit", "enabled", "window_start", "window_end",
                              "used", "alert").collect()}
    assert got == want
    assert any(a for _u, a in want.values())            # the default limits are exceeded
    alerts = BM.latest_alerts(spark.read.parquet(out + "_daily"))
    assert alerts.count() == sum(1 for k, (_u, a) in want.items() if a and k[1] == "daily")


def test_batch_window_rule_edges(spark):
    from datetime import datetime
    met = spark.createDataFrame(
        [(datetime(2024, 1, 1, 1), "AI_SERVICES", 10.0), (datetime(2024, 1, 2, 1), "AI_SERVICES", 10.5),
         (datetime(2024, 1, 2, 2), "WAREHOUSE_METERING", 99.0)],
        "start_time timestamp_ntz, service_type string, credits_used double")
    limits = spark.createDataFrame([("daily", 10.0, True)], "period string, `limit` double, enabled boolean")
    rows = {r.window_start.day: r for r in BM.budget_windows(met, limits, periods=("daily",),
                                                             watermark=None).collect()}
    # exactly at the limit: red light, no alert; over it: alert
    assert rows[1].light == "red" and not rows[1].alert
    assert rows[2].alert and rows[2].used == pytest.approx(10.5)
    with pytest.raises(KeyError):
        BM.windowed_spend(met, "yearly")
    month = BM.budget_windows(met, limits.selectExpr("'monthly' AS period", "`limit`", "enabled"),
                              periods=("monthly",), watermark=None).collect()
    assert [(r.window_start.month, r.window_end.month, r.used) for r in month] == [(1, 2, 20.5)]


def test_late_event_beyond_watermark_is_dropped(spark):
    from datetime import datetime
    root = tempfile.mkdtemp(prefix="metercast-late-")
    src = os.path.join(root, "feed")
    schema = "start_time timestamp_ntz, service_type string, credits_used double"
    on_time = [(datetime(2024, 1, 10, h), "AI_SERVICES", 1.0) for h in range(0, 24, 6)]
    spark.createDataFrame(on_time, schema).coalesce(1).write.mode("append").parquet(src)
    # a day later the feed has moved on; then an event from 9 days before arrives
    spark.createDataFrame([(datetime(2024, 1, 11, 12), "AI_SERVICES", 2.0)], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(datetime(2024, 1, 2, 12), "AI_SERVICES", 50.0)], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    limits = spark.createDataFrame([("daily", 3.0, True)], "period string, `limit` double, enabled boolean")
    out = os.path.join(root, "alerts")
    q = BM.start_budget_monitor(stream, limits, out, checkpoint_location=os.path.join(root, "ckpt"),
                                trigger={"availableNow": True})
    q.awaitTermination(300)
    assert q.exception() is None
    got = {r.window_start.day: r.used for r in spark.read.parquet(out).collect()}
    assert got == {10: 4.0, 11: 2.0}          # the 2 Jan event is behind the watermark
    batch = {r.window_start.day for r in BM.budget_windows(
        spark.read.parquet(src), limits, periods=("daily",), watermark=None).collect()}
    assert batch == {2, 10, 11}


def test_alerts_fire_once(spark):
    """Through the monitor and the second stream: one row per (limit, window), none on replay or restart."""
    from metercast.streaming import alert_once as AO
    root = tempfile.mkdtemp(prefix="metercast-once-")
    src, states, out = (os.path.join(root, x) for x in ("feed", "states", "alerts"))
    from datetime import datetime
    schema = "start_time timestamp_ntz, service_type string, credits_used double"
    limits = spark.createDataFrame([("a", "daily", 3.0, True), ("b", "daily", 9.0, True), ("off", "daily", 1.0, False)],
                                   "profile string, period string, `limit` double, enabled boolean")

    def feed(*credits):
        spark.createDataFrame([(datetime(2024, 1, d, 5), "AI_SERVICES", c) for d, c in credits], schema) \
            .coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        monitor = BM.start_budget_monitor(stream, limits, states, checkpoint_location=os.path.join(root, "c1"),
                                          trigger={"availableNow": True})
        assert monitor.awaitTermination(60) and monitor.exception() is None
        q = AO.start_first_alerts(states, spark, out, checkpoint_location=os.path.join(root, "c2"), keep="9 days", trigger={"availableNow": True})
        assert q.awaitTermination(60) and q.exception() is None
        return sorted((r.profile, r.window_start.day, r.used) for r in spark.read.parquet(out).collect())
    feed((10, 2.0))                                    # below both limits
    assert run() == []
    feed((10, 2.0))                                    # over a's: fires
    feed((10, 1.0))                                    # still over: nothing new
    assert run() == [("a", 10, 4.0)]
    feed((10, 5.0), (11, 4.5))                         # b's limit on the 10th, a's on the 11th; after a restart
    want = [("a", 10, 4.0), ("a", 11, 4.5), ("b", 10, 10.0)]
    assert run() == want
    part = spark.read.parquet(states).where("batch_id = 1").drop("batch_id").coalesce(1)
    part.write.mode("append").parquet(os.path.join(states, "batch_id=1"))  # a replayed batch's files come again
    assert run() == want
    feed((31, 1.0))                                    # 20 days on (keep: 9 days): the state of the 10th is dropped
    assert run() == want
    part.write.mode("append").parquet(os.path.join(states, "batch_id=1"))
    assert run() == want                               # and its rows are late: nothing fires again
    batch = AO.first_alerts(spark.read.parquet(states))
    assert sorted((r.profile, r.window_start.day, r.used) for r in batch.collect()) == want


def test_crossings_of_limits(spark):
    from datetime import datetime
    rows = [(datetime(2024, 1, 31, 3, 10), "AI_SERVICES", 2.0), (datetime(2024, 1, 31, 3, 50), "AI_SERVICES", 1.0),
            (datetime(2024, 1, 31, 7), "AI_SERVICES", 0.5), (datetime(2024, 1, 31, 9), "AI_SERVICES", -3.0),
            (datetime(2024, 2, 1, 1), "AI_SERVICES", 3.0), (datetime(2024, 2, 1, 2), "OTHER", 99.0), (None, "AI_SERVICES", 50.0)]
    met = spark.createDataFrame(rows, "start_time timestamp_ntz, service_type string, credits_used double")
    limits = spark.createDataFrame([("daily", 3.0, True), ("weekly", 3.4, True), ("monthly", 2.9, True), ("daily", 0.1, False)],
                                   "period string, `limit` double, enabled boolean")
    got = {(r.period, r.window_start.month, r.window_start.day): (r.crossed_at.day, r.crossed_at.hour, r.used)
           for r in BM.limit_crossings(met, limits).collect()}
    # exactly at the limit is no crossing; the correction at 9 does not take one back
    assert got.pop(("daily", 1, 31)) == (31, 7, 3.5)
    assert got.pop(("monthly", 1, 1)) == (31, 3, 3.0) and got.pop(("monthly", 2, 1)) == (1, 1, 3.0)
    assert all(p == "weekly" and v == (31, 7, 3.5) for (p, *_), v in got.items()) and len(got) == 7
    assert BM.limit_crossings(met.limit(0), limits).count() == 0
