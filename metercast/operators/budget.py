"""Budget status and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands, money
from .common import at_or_after, credit_e8, date_literal, ts_literal

PERIODS = ["daily", "weekly", "monthly"]


def period_usage(metering: DataFrame, as_of, service_type: str = "AI_SERVICES") -> DataFrame:
    """Credits used today, in the rolling 7 days and month to date, in one
    pass (A10). The scan gets an explicit lower bound (the earliest of the
    three period starts) so it prunes instead of reading all history."""
    now = ts_literal(metering, "start_time", as_of)
    today = date_literal(as_of)
    week_start = now - F.make_dt_interval(F.lit(7))
    month_start = F.date_trunc("month", now).cast(metering.schema["start_time"].dataType)
    day_start = today.cast(metering.schema["start_time"].dataType)
    lower = F.least(week_start, month_start, day_start)
    m = metering.where((F.col("service_type") == service_type)
                       & at_or_after(metering, "start_time", lower))
    e8 = credit_e8(m, "credits_used")
    zero = F.lit(0).cast("long")
    g = m.agg(
        money.exact_sum(F.when(F.to_date("start_time") == today, e8).otherwise(zero)).alias("d"),
        money.exact_sum(F.when(F.col("start_time") >= week_start, e8).otherwise(zero)).alias("w"),
        money.exact_sum(F.when(F.col("start_time") >= month_start, e8).otherwise(zero)).alias("m"))
    return periods_of_sums(g)


def periods_of_sums(g: DataFrame) -> DataFrame:
    """(period, used) of the one row of exact sums ``d``, ``w`` and ``m``."""
    return g.select(F.explode(F.array(
        *[F.struct(F.lit(p).alias("period"),
                   F.coalesce(money.e8_to_credits(c), F.lit(0.0)).alias("used"))
          for p, c in zip(PERIODS, ["d", "w", "m"])])).alias("s")).select("s.*")


def budget_status(metering: DataFrame, limits: DataFrame, as_of,
                  service_type: str = "AI_SERVICES", price: float = 3.0) -> DataFrame:
    """Per limit row (``period``, ``limit``, ``enabled`` + any profile
    columns): used credits, cost, percent of the limit and its light."""
    return status_of_usage(period_usage(metering, as_of, service_type), limits, price)


def status_of_usage(used: DataFrame, limits: DataFrame, price: float = 3.0) -> DataFrame:
    """The lights of :func:`budget_status` from the credits used in each period."""
    # ``used`` is three rows by construction (one global aggregate, exploded)
    j = limits.join(F.broadcast(used), "period", "left")
    u = F.coalesce(F.col("used"), F.lit(0.0))
    pct = bands.budget_pct(u, F.col("limit"), F.col("enabled"))
    return j.select(*limits.columns, u.alias("used"),
                    (u * F.lit(price)).alias("used_usd"),
                    pct.alias("pct"), bands.budget_light(pct).alias("light"))


def active_alerts(status: DataFrame) -> DataFrame:
    """Limits strictly exceeded and enabled (C14): exactly 100 % is red but
    raises no alert."""
    return status.where(F.col("enabled") & (F.col("used") > F.col("limit")))
