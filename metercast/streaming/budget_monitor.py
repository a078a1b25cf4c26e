"""Budget monitoring over a metering feed (C13/C14 as Structured Streaming).

The same operator runs on a batch frame and on a stream: spend is summed per
event-time window (a 1-day tumbling window for the daily limit, a 7-day
window sliding by one day for the rolling week), the limits are a small
static dimension joined by broadcast, and the alert rule is the batch one
(enabled and strictly over the limit). On a stream the watermark bounds the
window state: a day's state is dropped once the feed is ``watermark`` past the
day's end, chosen from the stated 2-3 hour lag of the usage views.

Calendar months have no fixed duration, so the monthly period groups by the
month's first instant instead of a ``window``; on a stream the watermark is
set on that month start, which moves by whole months. It is 31 days longer
than the given one: a month counts late rows until the month after the next
begins, then it leaves the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import bands, money
from ..operators.common import credit_e8, dimension

DEFAULT_WATERMARK = "3 hours"
# Window per period (duration, slide).
PERIOD_WINDOWS = {"daily": ("1 day", None), "weekly": ("7 days", "1 day"), "monthly": ("1 month", None)}


def _spend_e8(metering: DataFrame, period: str, service_type: str | None,
              watermark: str | None, time_col: str) -> DataFrame:
    duration, slide = PERIOD_WINDOWS[period]
    src_type = metering.schema[time_col].dataType
    # event time must be TIMESTAMP for a watermark; an NTZ log is read as
    # wall-clock time in the session time zone (UTC) and cast back at the end
    m = metering.withColumn("_event_time", F.col(time_col).cast("timestamp"))
    if period == "monthly":
        start = F.date_trunc("month", F.col("_event_time"))
        m = m.withColumn("_month", start)
        if watermark:
            # the watermark moves in steps of months: with 31 days more a
            # month stays open for late rows until the month after the next
            # begins, and two or three months are held in state
            m = m.withWatermark("_month", f"31 days {watermark}")
        win = None
    else:
        if watermark:
            m = m.withWatermark("_event_time", watermark)
        win = F.window("_event_time", duration, slide) if slide else F.window("_event_time", duration)
    if service_type is not None:
        m = m.where(F.col("service_type") == service_type)
    spent = money.exact_sum(credit_e8(m, "credits_used")).alias("_e8")
    if win is None:  # grouped by the watermarked column itself, so that closed months leave the state
        g = m.groupBy("_month").agg(spent)
        return g.select(F.lit(period).alias("period"), F.col("_month").cast(src_type).alias("window_start"),
                        F.add_months(F.col("_month"), 1).cast("timestamp").cast(src_type).alias("window_end"), "_e8")
    g = m.groupBy(win.alias("w")).agg(spent)
    return g.select(F.lit(period).alias("period"),
                    F.col("w.start").cast(src_type).alias("window_start"),
                    F.col("w.end").cast(src_type).alias("window_end"), "_e8")


def _used(spend_e8: DataFrame) -> DataFrame:
    return spend_e8.select("period", "window_start", "window_end",
                           money.e8_to_credits("_e8").alias("used"))


def windowed_spend(metering: DataFrame, period: str = "daily",
                   service_type: str | None = "AI_SERVICES",
                   watermark: str | None = DEFAULT_WATERMARK, time_col: str = "start_time") -> DataFrame:
    """Credits per event-time window of ``period`` (exact sum, then double).
    ``watermark=None`` leaves the frame without one (batch use)."""
    return _used(_spend_e8(metering, period, service_type, watermark, time_col))


def _batch_spend(metering: DataFrame, periods, service_type: str | None,
                 time_col: str) -> DataFrame:
    """All periods from one scan (batch only): the daily windows are summed
    once; a 7-day window sliding by a day is the exact integer sum of its
    seven day-aligned daily windows, and a calendar month the sum of its
    days, both taken over the small daily table. Both
    branches share the daily shuffle (adaptive execution reuses the identical
    exchange), so the log is read once."""
    daily = _spend_e8(metering, "daily", service_type, None, time_col)
    out = []
    if "daily" in periods:
        out.append(daily)
    if "weekly" in periods:
        k = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("_k")
        d = daily.select("window_start", "_e8", k)
        start = F.col("window_start") - F.make_dt_interval(F.col("_k"))
        weekly = (d.groupBy(start.alias("window_start"))
                   .agg(F.sum("_e8").alias("_e8"))
                   .select(F.lit("weekly").alias("period"), "window_start",
                           (F.col("window_start") + F.make_dt_interval(F.lit(7))).alias("window_end"),
                           "_e8"))
        out.append(weekly)
    if "monthly" in periods:
        month = F.date_trunc("month", F.col("window_start")).cast(daily.schema["window_start"].dataType)
        monthly = (daily.groupBy(month.alias("window_start")).agg(F.sum("_e8").alias("_e8"))
                        .select(F.lit("monthly").alias("period"), "window_start",
                                F.add_months(F.col("window_start"), 1)
                                 .cast(daily.schema["window_start"].dataType).alias("window_end"),
                                "_e8"))
        out.append(monthly)
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return _used(res)


def check_limits(spend: DataFrame, limits: DataFrame, price: float = 3.0) -> DataFrame:
    """Per window and limit row of the same period: used, cost, percent of
    the limit, light, and whether it raises an alert (strictly over).
    ``limits`` is expected to carry its broadcast decision already
    (:func:`metercast.operators.common.dimension`), taken once per query."""
    j = spend.join(limits, "period", "inner")
    pct = bands.budget_pct(F.col("used"), F.col("limit"), F.col("enabled"))
    return j.select(*[c for c in limits.columns if c != "period"], "period",
                    "window_start", "window_end", "used",
                    (F.col("used") * F.lit(price)).alias("used_usd"),
                    pct.alias("pct"), bands.budget_light(pct).alias("light"),
                    (F.col("enabled") & (F.col("used") > F.col("limit"))).alias("alert"))


def budget_windows(metering: DataFrame, limits: DataFrame, periods=("daily", "weekly"),
                   service_type: str | None = "AI_SERVICES", price: float = 3.0,
                   watermark: str | None = DEFAULT_WATERMARK,
                   time_col: str = "start_time") -> DataFrame:
    """All windowed periods checked against their limits. A stream gets one
    watermarked window aggregation per period; a batch frame is scanned once
    (the weekly windows are derived from the daily ones)."""
    unknown = [p for p in periods if p not in PERIOD_WINDOWS]
    if unknown:
        raise KeyError(f"no window for periods {unknown}")
    limits = dimension(limits)
    if metering.isStreaming:
        spend = None
        for p in periods:
            part = windowed_spend(metering, p, service_type, watermark, time_col)
            spend = part if spend is None else spend.unionByName(part)
    else:
        spend = _batch_spend(metering, list(periods), service_type, time_col)
    return check_limits(spend, limits, price)


def _checkpoint_root(spark: SparkSession) -> str:
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise ValueError("spark.checkpoint.dir is not set: a streaming query needs a shared folder")
    return d.rstrip("/")


def start_budget_monitor(metering_stream: DataFrame, limits: DataFrame, alerts_path: str,
                         period: str = "daily", checkpoint_location: str | None = None,
                         service_type: str | None = "AI_SERVICES", price: float = 3.0,
                         watermark: str = DEFAULT_WATERMARK, trigger: dict | None = None,
                         query_name: str | None = None) -> StreamingQuery:
    """Start the monitor: windowed spend in ``update`` mode (a window's
    running total is emitted every micro-batch it changes in, so an alert
    fires in the batch that crosses the limit, not after the window closes),
    checked against the limits and appended to ``alerts_path``.

    The sink writes each micro-batch into its own ``batch_id`` partition
    with dynamic overwrite, so a batch replayed after a failure replaces its
    own output instead of duplicating it. Offsets and window state live in
    ``checkpoint_location`` (default: a folder under the session's shared
    ``spark.checkpoint.dir``), so a restarted query resumes where it stopped.
    """
    spark = metering_stream.sparkSession
    ckpt = checkpoint_location or f"{_checkpoint_root(spark)}/budget-monitor-{period}"
    spend = windowed_spend(metering_stream, period, service_type, watermark)
    limits = dimension(limits)  # size checked once, not per micro-batch

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        checked = check_limits(batch, limits, price).withColumn("batch_id", F.lit(batch_id))
        (checked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id").parquet(alerts_path))

    w = spend.writeStream.outputMode("update").option("checkpointLocation", ckpt) \
             .foreachBatch(write_batch)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(**(trigger or {"processingTime": "1 minute"}))
    return w.start()


def latest_alerts(alerts: DataFrame) -> DataFrame:
    """The latest emitted state of every (limit, window) from the monitor's
    output (the update-mode rows of later batches supersede earlier ones),
    restricted to alerts. One aggregate with a struct-max per key."""
    keys = [c for c in alerts.columns
            if c not in ("batch_id", "used", "used_usd", "pct", "light", "alert")]
    last = alerts.groupBy(*keys).agg(
        F.max(F.struct("batch_id", "used", "used_usd", "pct", "light", "alert")).alias("_s"))
    return (last.select(*keys, "_s.used", "_s.used_usd", "_s.pct", "_s.light", "_s.alert")
                .where(F.col("alert")))


def limit_crossings(metering: DataFrame, limits: DataFrame, service_type: str | None = "AI_SERVICES",
                    time_col: str = "start_time") -> DataFrame:
    """When each enabled limit was first exceeded in each of its windows (batch): the limit's columns, period,
    window_start, window_end, crossed_at (start of the hour in which the running total passed the limit), used (the total
    at that hour's end). Windows that stay within their limit have no row.

    The log is summed by hour first; running totals then go over the hours of
    a window, at most 168 (a month: 744), whatever the log's size. Where
    corrections bring a total back under its limit, the first crossing counts.
    """
    kind = metering.schema[time_col].dataType
    m = metering if service_type is None else metering.where(F.col("service_type") == service_type)
    hour = F.date_trunc("hour", F.col(time_col).cast("timestamp")).cast(kind)
    hourly = (m.where(F.col(time_col).isNotNull()).groupBy(hour.alias("_hour"))
              .agg(money.exact_sum(credit_e8(m, "credits_used")).alias("_e8")))
    day, days = F.date_trunc("day", F.col("_hour").cast("timestamp")).cast(kind), lambda n: F.make_dt_interval(F.lit(n))
    month = F.date_trunc("month", F.col("_hour").cast("timestamp")).cast(kind)
    k = F.explode(F.sequence(F.lit(0), F.lit(6)))
    of = [hourly.select(F.lit("daily").alias("period"), day.alias("window_start"), (day + days(1)).alias("window_end"), "_hour", "_e8"),
          hourly.withColumn("_k", k).select(F.lit("weekly").alias("period"), (day - F.make_dt_interval(F.col("_k"))).alias("window_start"),
                                            (day - F.make_dt_interval(F.col("_k")) + days(7)).alias("window_end"), "_hour", "_e8"),
          hourly.select(F.lit("monthly").alias("period"), month.alias("window_start"),
                        F.add_months(month, 1).cast(kind).alias("window_end"), "_hour", "_e8")]
    rows = of[0].unionByName(of[1]).unionByName(of[2])
    so_far = F.sum("_e8").over(Window.partitionBy("period", "window_start").orderBy("_hour")
                               .rowsBetween(Window.unboundedPreceding, 0))
    running = rows.withColumn("used", money.e8_to_credits(so_far))
    over = running.join(dimension(limits), "period").where(F.col("enabled") & (F.col("used") > F.col("limit")))
    names = [c for c in limits.columns if c != "period"]
    first = over.groupBy(*names, "period", "window_start", "window_end").agg(F.min(F.struct("_hour", "used")).alias("_first"))
    return first.select(*names, "period", "window_start", "window_end", F.col("_first._hour").alias("crossed_at"), "_first.used")
