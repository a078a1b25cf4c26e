"""Registered queries over metering and the per-service usage facts
(C7, C8, C10, C13, C14, C32 and the windowed budget check)."""

from __future__ import annotations

from ..operators import budget as B
from ..operators import forecast as FC
from ..operators import reconcile as R
from ..operators import usage as U
from ..sources.testdata import AS_OF_EVENTS, TestData
from ..streaming import budget_monitor as BM
from . import fixtures_sql as X
from .registry import register, td


# --- C7 / C32 over metering ---------------------------------------------------------

@register("daily_usage", X.with_(X.METERING) + f"""
SELECT CAST(start_time AS DATE) AS usage_date, service_type, CAST(SUM(e8) AS DOUBLE) / 1e8 AS credits
FROM metering
WHERE start_time >= {X.ev_lookback(30)} AND service_type = 'AI_SERVICES'
GROUP BY 1, 2""")
def q_daily_usage(spark, sf_dir):
    return U.daily_usage(td(spark, sf_dir).metering(), AS_OF_EVENTS, 30)


@register("usage_overview", X.with_(X.METERING) + f"""
SELECT CAST(e8 AS DOUBLE) / 1e8 AS total_credits,
       CAST(e8 * 300 AS DOUBLE) / 1e10 AS total_cost,
       CAST(e8 AS DOUBLE) / 1e8 / 30.0 AS avg_daily_credits,
       CAST(e8 AS DOUBLE) / 1e8 / 30.0 * 30.0 AS projected_monthly_credits
FROM (SELECT COALESCE(SUM(e8), 0) AS e8 FROM metering
      WHERE start_time >= {X.ev_lookback(30)} AND service_type = 'AI_SERVICES') t""")
def q_usage_overview(spark, sf_dir):
    return U.usage_overview(td(spark, sf_dir).metering(), AS_OF_EVENTS, 30, 3.0)


@register("daily_service_usage", X.with_(X.METERING, X.METERING_DAILY) + f"""
SELECT usage_date, service_type, credits_used, credits_used_compute, credits_used_cloud_services
FROM metering_daily
WHERE service_type = 'AI_SERVICES' AND usage_date >= DATE '{AS_OF_EVENTS[:10]}' - INTERVAL 14 DAY""")
def q_daily_service_usage(spark, sf_dir):
    return U.daily_service_usage(td(spark, sf_dir).metering_daily(), AS_OF_EVENTS, 14)


@register("hourly_function_usage", X.with_(X.USAGE_HOURLY) + f"""
SELECT start_time, end_time, function_name, model_name, warehouse_id, token_credits, tokens
FROM usage_hourly WHERE start_time >= {X.ev_lookback(7)}""")
def q_hourly_function_usage(spark, sf_dir):
    return U.hourly_function_usage(td(spark, sf_dir).usage_hourly(), AS_OF_EVENTS, 7)


@register("analyst_usage", X.with_(X.service_sql("analyst")) + f"""
SELECT start_time, CAST(e8 AS DOUBLE) / 1e8 AS credits
FROM analyst WHERE start_time >= {X.ev_lookback(30)}""")
def q_analyst_usage(spark, sf_dir):
    a = td(spark, sf_dir).service("analyst")
    return U.analyst_usage(a, AS_OF_EVENTS, 30).drop("credits_e8")


@register("search_usage", X.with_(X.SEARCH_DAILY) + f"""
SELECT * FROM search_daily WHERE usage_date >= DATE '{AS_OF_EVENTS[:10]}' - INTERVAL 30 DAY""")
def q_search_usage(spark, sf_dir):
    return U.search_usage(td(spark, sf_dir).search_daily(), AS_OF_EVENTS, 30)


# --- C8 forecast ------------------------------------------------------------------


def _forecast_sql(daily_cte: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    # actual rows of the keys that have a forecast
    has_forecast = f"SEMI JOIN s USING ({keys})" if keys else "WHERE EXISTS (SELECT 1 FROM s)"
    return X.with_(X.METERING, daily_cte, f"""s AS (
  SELECT {k}COUNT(*) AS n, arg_min(credits, usage_date) AS first_v,
         arg_max(credits, usage_date) AS last_v, max(usage_date) AS last_date
  FROM d {grp} HAVING COUNT(*) > 1)""") + f"""
SELECT {k}usage_date, CAST(credits AS DOUBLE) AS credits, 'Actual' AS type FROM d {has_forecast}
UNION ALL
SELECT {k}CAST(last_date + CAST(i + 1 AS INTEGER) AS DATE) AS usage_date,
       greatest(last_v + ((last_v - first_v) / CAST(n - 1 AS DOUBLE)) * CAST(i AS DOUBLE), 0.0) AS credits,
       'Forecast' AS type
FROM s CROSS JOIN range(0, 30) t(i)"""


@register("forecast_30d", _forecast_sql(f"""d AS (
  SELECT CAST(start_time AS DATE) AS usage_date, CAST(SUM(e8) AS DOUBLE) / 1e8 AS credits
  FROM metering WHERE start_time >= {X.ev_lookback(30)} AND service_type = 'AI_SERVICES'
  GROUP BY 1)""", ""))
def q_forecast_30d(spark, sf_dir):
    daily = U.daily_usage(td(spark, sf_dir).metering(), AS_OF_EVENTS, 30, ordered=False)
    return FC.forecast(FC.daily_totals(daily), horizon=30)


@register("forecast_by_service", _forecast_sql(f"""d AS (
  SELECT service_type, CAST(start_time AS DATE) AS usage_date, CAST(SUM(e8) AS DOUBLE) / 1e8 AS credits
  FROM metering WHERE start_time >= {X.ev_lookback(30)}
  GROUP BY 1, 2)""", "service_type"))
def q_forecast_by_service(spark, sf_dir):
    daily = U.daily_usage(td(spark, sf_dir).metering(), AS_OF_EVENTS, 30, service_type=None,
                          ordered=False)
    return FC.forecast(daily, keys=["service_type"], horizon=30)


# --- C13 / C14 budget ----------------------------------------------------------------

_LIMITS_SQL = """limits AS (SELECT * FROM (VALUES
  ('default', 'daily', 10.0::DOUBLE, TRUE), ('default', 'weekly', 50.0::DOUBLE, TRUE),
  ('default', 'monthly', 200.0::DOUBLE, TRUE),
  ('scaled', 'daily', 20000.0::DOUBLE, TRUE), ('scaled', 'weekly', 100000.0::DOUBLE, TRUE),
  ('scaled', 'monthly', 300000.0::DOUBLE, TRUE),
  ('disabled', 'daily', 1.0::DOUBLE, FALSE), ('disabled', 'weekly', 5.0::DOUBLE, FALSE),
  ('disabled', 'monthly', 20.0::DOUBLE, FALSE)) v(profile, period, "limit", enabled))"""

_NOW = f"TIMESTAMP '{AS_OF_EVENTS}'"
_BUDGET = X.with_(X.METERING, _LIMITS_SQL, f"""u AS (
  SELECT SUM(CASE WHEN CAST(start_time AS DATE) = DATE '{AS_OF_EVENTS[:10]}' THEN e8 ELSE 0 END) AS d,
         SUM(CASE WHEN start_time >= {_NOW} - INTERVAL 7 DAY THEN e8 ELSE 0 END) AS w,
         SUM(CASE WHEN start_time >= date_trunc('month', {_NOW}) THEN e8 ELSE 0 END) AS m
  FROM metering WHERE service_type = 'AI_SERVICES'),
p AS (SELECT 'daily' AS period, COALESCE(CAST(d AS DOUBLE) / 1e8, 0.0) AS used FROM u
      UNION ALL SELECT 'weekly', COALESCE(CAST(w AS DOUBLE) / 1e8, 0.0) FROM u
      UNION ALL SELECT 'monthly', COALESCE(CAST(m AS DOUBLE) / 1e8, 0.0) FROM u),
st AS (
  SELECT profile, period, "limit", enabled, COALESCE(used, 0.0) AS used,
         COALESCE(used, 0.0) * 3.0 AS used_usd,
         CASE WHEN enabled AND "limit" > 0 THEN COALESCE(used, 0.0) / "limit" * 100.0 ELSE 0.0 END AS pct
  FROM limits LEFT JOIN p USING (period))""")


@register("budget_status", _BUDGET + """
SELECT *, CASE WHEN pct < 80.0 THEN 'green' WHEN pct < 100.0 THEN 'yellow' ELSE 'red' END AS light
FROM st""")
def q_budget_status(spark, sf_dir):
    t = td(spark, sf_dir)
    return B.budget_status(t.metering(), t.limits(), AS_OF_EVENTS)


@register("active_alerts", _BUDGET + """
SELECT *, CASE WHEN pct < 80.0 THEN 'green' WHEN pct < 100.0 THEN 'yellow' ELSE 'red' END AS light
FROM st WHERE enabled AND used > "limit" """)
def q_active_alerts(spark, sf_dir):
    t = td(spark, sf_dir)
    return B.active_alerts(B.budget_status(t.metering(), t.limits(), AS_OF_EVENTS))


# --- C10 reconciliation ------------------------------------------------------------------

def service_sources(t: TestData) -> list:
    def functions():
        return t.fn_usage().join(t.fn_history(), "query_id", "inner")
    return [
        R.SourceSpec("AI Functions", functions, "token_credits",
                     where=lambda df: df.function_name != "AI_EXTRACT"),
        R.SourceSpec("Analyst", lambda: t.service("analyst"), "credits"),
        R.SourceSpec("Document Processing", lambda: t.service("docproc"), "credits_used"),
        R.SourceSpec("Search", lambda: t.service("search"), "credits"),
        R.SourceSpec("Fine Tuning", lambda: t.service("finetune"), "token_credits"),
    ]


_EV30 = X.ev_lookback(30)
_RECON = X.with_(X.METERING, X.FN_USAGE, X.service_sql("analyst"), X.service_sql("docproc"),
                 X.service_sql("search"), X.service_sql("finetune"), f"""s AS (
  SELECT 'AI Functions' AS service, COALESCE(SUM(e8), 0) AS e8 FROM fn_usage
    WHERE start_time >= {_EV30} AND function_name <> 'AI_EXTRACT'
  UNION ALL SELECT 'Analyst', COALESCE(SUM(e8), 0) FROM analyst WHERE start_time >= {_EV30}
  UNION ALL SELECT 'Document Processing', COALESCE(SUM(e8), 0) FROM docproc WHERE start_time >= {_EV30}
  UNION ALL SELECT 'Search', COALESCE(SUM(e8), 0) FROM search WHERE start_time >= {_EV30}
  UNION ALL SELECT 'Fine Tuning', COALESCE(SUM(e8), 0) FROM finetune WHERE start_time >= {_EV30}),
b AS (SELECT COALESCE(SUM(e8), 0) AS b FROM metering
      WHERE start_time >= {_EV30} AND service_type = 'AI_SERVICES'),
g AS (SELECT SUM(e8) AS g FROM s)""")


@register("reconcile_services", _RECON + """
SELECT service, CAST(e8 AS DOUBLE) / 1e8 AS credits, 'OK' AS status FROM s""")
def q_reconcile_services(spark, sf_dir):
    return R.reconcile_services(service_sources(td(spark, sf_dir)), AS_OF_EVENTS, 30)


@register("reconcile_summary", _RECON + """
SELECT baseline_credits, granular_total, variance, variance_pct, coverage_pct,
       CASE WHEN abs(variance_pct) <= 1.0 THEN 'EXCELLENT' WHEN abs(variance_pct) <= 5.0 THEN 'GOOD'
            WHEN abs(variance_pct) <= 15.0 THEN 'WARNING' ELSE 'CRITICAL' END AS status,
       baseline_credits <= 0 AS baseline_missing, CAST(0 AS BIGINT) AS sources_missing
FROM (SELECT CAST(b AS DOUBLE) / 1e8 AS baseline_credits, CAST(g AS DOUBLE) / 1e8 AS granular_total,
             CAST(g - b AS DOUBLE) / 1e8 AS variance,
             CASE WHEN CAST(b AS DOUBLE) / 1e8 > 0
                  THEN CAST(g - b AS DOUBLE) / 1e8 / (CAST(b AS DOUBLE) / 1e8) * 100.0 ELSE 0.0 END AS variance_pct,
             CASE WHEN CAST(b AS DOUBLE) / 1e8 > 0
                  THEN CAST(g AS DOUBLE) / 1e8 / (CAST(b AS DOUBLE) / 1e8) * 100.0 ELSE 0.0 END AS coverage_pct
      FROM b CROSS JOIN g) x""")
def q_reconcile_summary(spark, sf_dir):
    t = td(spark, sf_dir)
    return R.reconcile(t.metering(), service_sources(t), AS_OF_EVENTS, 30)


# --- windowed budget check (batch form of the streaming monitor) ---------------------


@register("budget_windows", X.with_(X.METERING, _LIMITS_SQL, """ai AS (
  SELECT start_time, e8 FROM metering WHERE service_type = 'AI_SERVICES'),
spend AS (
  SELECT 'daily' AS period, date_trunc('day', start_time) AS window_start,
         date_trunc('day', start_time) + INTERVAL 1 DAY AS window_end, SUM(e8) AS e8
  FROM ai GROUP BY 2, 3
  UNION ALL
  SELECT 'weekly', date_trunc('day', start_time) - k * INTERVAL 1 DAY,
         date_trunc('day', start_time) - k * INTERVAL 1 DAY + INTERVAL 7 DAY, SUM(e8)
  FROM ai CROSS JOIN range(0, 7) r(k) GROUP BY 2, 3)""") + """
SELECT profile, "limit", enabled, period, CAST(window_start AS TIMESTAMP) AS window_start,
       CAST(window_end AS TIMESTAMP) AS window_end, used, used * 3.0 AS used_usd, pct,
       CASE WHEN pct < 80.0 THEN 'green' WHEN pct < 100.0 THEN 'yellow' ELSE 'red' END AS light,
       enabled AND used > "limit" AS alert
FROM (SELECT *, CAST(e8 AS DOUBLE) / 1e8 AS used,
             CASE WHEN enabled AND "limit" > 0 THEN CAST(e8 AS DOUBLE) / 1e8 / "limit" * 100.0
                  ELSE 0.0 END AS pct
      FROM spend JOIN limits USING (period)) x""")
def q_budget_windows(spark, sf_dir):
    t = td(spark, sf_dir)
    return BM.budget_windows(t.metering(), t.limits(), watermark=None)


@register("budget_windows_monthly", X.with_(X.METERING, _LIMITS_SQL, """spend AS (
  SELECT 'monthly' AS period, date_trunc('month', start_time) AS window_start,
         date_trunc('month', start_time) + INTERVAL 1 MONTH AS window_end, SUM(e8) AS e8
  FROM metering WHERE service_type = 'AI_SERVICES' GROUP BY 2, 3)""") + """
SELECT profile, "limit", enabled, period, CAST(window_start AS TIMESTAMP) AS window_start,
       CAST(window_end AS TIMESTAMP) AS window_end, used, used * 3.0 AS used_usd, pct,
       CASE WHEN pct < 80.0 THEN 'green' WHEN pct < 100.0 THEN 'yellow' ELSE 'red' END AS light,
       enabled AND used > "limit" AS alert
FROM (SELECT *, CAST(e8 AS DOUBLE) / 1e8 AS used,
             CASE WHEN enabled AND "limit" > 0 THEN CAST(e8 AS DOUBLE) / 1e8 / "limit" * 100.0
                  ELSE 0.0 END AS pct
      FROM spend JOIN limits USING (period)) x""")
def q_budget_windows_monthly(spark, sf_dir):
    t = td(spark, sf_dir)
    return BM.budget_windows(t.metering(), t.limits(), periods=("monthly",), watermark=None)


@register("limit_crossings", X.with_(X.METERING, _LIMITS_SQL, """h AS (
  SELECT date_trunc('hour', start_time) AS hour, SUM(e8) AS e8 FROM metering WHERE service_type = 'AI_SERVICES' GROUP BY 1)""",
"""w AS (
  SELECT 'daily' AS period, date_trunc('day', hour) AS window_start,
         date_trunc('day', hour) + INTERVAL 1 DAY AS window_end, hour, e8 FROM h
  UNION ALL
  SELECT 'weekly', date_trunc('day', hour) - k * INTERVAL 1 DAY,
         date_trunc('day', hour) - k * INTERVAL 1 DAY + INTERVAL 7 DAY, hour, e8 FROM h CROSS JOIN range(0, 7) r(k)
  UNION ALL
  SELECT 'monthly', date_trunc('month', hour), date_trunc('month', hour) + INTERVAL 1 MONTH, hour, e8 FROM h)""",
"""t AS (
  SELECT period, window_start, window_end, hour,
         CAST(SUM(e8) OVER (PARTITION BY period, window_start ORDER BY hour) AS DOUBLE) / 1e8 AS used FROM w)""") + """
SELECT profile, "limit", enabled, period, CAST(window_start AS TIMESTAMP) AS window_start,
       CAST(window_end AS TIMESTAMP) AS window_end, CAST(MIN(hour) AS TIMESTAMP) AS crossed_at, arg_min(used, hour) AS used
FROM t JOIN limits USING (period) WHERE enabled AND used > "limit" GROUP BY profile, "limit", enabled, period, t.window_start, t.window_end""")
def q_limit_crossings(spark, sf_dir):
    """C14: the hour in which each limit was first exceeded, in every daily, weekly and monthly window."""
    t = td(spark, sf_dir)
    return BM.limit_crossings(t.metering(), t.limits())
