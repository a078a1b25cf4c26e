"""The logical tables of FIXTURES.md as portable SQL CTEs over the raw test
views (``lineitem``, ``orders``, ``events`` ...). Used by the oracle queries
that check the DataFrame operators; written independently of them."""

from __future__ import annotations

from ..sources import catalog as cat
from ..sources import testdata as td


def _case(expr: str, mapping, cast: str | None = None) -> str:
    parts = " ".join(f"WHEN {k} THEN {v if cast else cat._q(v)}" for k, v in mapping)
    return f"CASE {expr} {parts} END"


def _rates():
    return td._rate_map()


CENTS = "CAST(round({x} * 100) AS BIGINT)"

USAGE = f"""usage AS (
  SELECT l_orderkey AS query_id,
         {_case('l_linenumber', td.LINE_FUNCTIONS)} AS function_name,
         {_case('l_partkey % 8', td.MOD8_MODELS)} AS model_name,
         CAST(round(l_quantity * 100) AS BIGINT) AS tokens,
         CAST({_case('l_partkey % 8', _rates(), cast='int')} AS BIGINT) AS rate_centi
  FROM lineitem)"""

# token_credits of a usage row and the exact sum of a group
TOKEN_CREDITS = "CAST(tokens * rate_centi AS DOUBLE) / 1e8"
SUM_CREDITS = "CAST(SUM(tokens * rate_centi) AS DOUBLE) / 1e8"

QH = """qh AS (
  SELECT o_orderkey AS query_id,
         CAST('order ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority AS VARCHAR) AS query_text,
         o_orderdate AS start_time,
         CAST(round(o_totalprice * 100) AS BIGINT) AS execution_time,
         c_name AS user_name, o_orderpriority AS warehouse_name, c_mktsegment AS role_name
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

# events with the service type of their metering row
EVENTS_CLASSIFIED = ("(SELECT *, CASE WHEN event_id % 5 = 4 THEN 'WAREHOUSE_METERING' "
                     "ELSE 'AI_SERVICES' END AS service_type FROM events) ev")

METERING = """metering AS (
  SELECT ts AS start_time,
         CASE WHEN event_id % 5 = 4 THEN 'WAREHOUSE_METERING' ELSE 'AI_SERVICES' END AS service_type,
         CAST(round(value * 100) AS BIGINT) * 1000000 AS e8,
         event_type
  FROM events)"""

METERING_DAILY = """metering_daily AS (
  SELECT CAST(start_time AS DATE) AS usage_date, service_type,
         CAST(SUM(e8) AS DOUBLE) / 1e8 AS credits_used,
         CAST(SUM(CASE WHEN event_type <> 'error' THEN e8 ELSE 0 END) AS DOUBLE) / 1e8 AS credits_used_compute,
         CAST(SUM(CASE WHEN event_type = 'error' THEN e8 ELSE 0 END) AS DOUBLE) / 1e8 AS credits_used_cloud_services
  FROM metering GROUP BY 1, 2)"""

USAGE_HOURLY = f"""usage_hourly AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start_time,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL 1 HOUR AS end_time,
         {_case('event_id % 7 + 1', td.LINE_FUNCTIONS)} AS function_name,
         {_case('user_id % 8', td.MOD8_MODELS)} AS model_name,
         user_id AS warehouse_id,
         CAST(CAST(round(value * 100) AS BIGINT) * {_case('user_id % 8', _rates(), cast='int')} AS DOUBLE) / 1e8 AS token_credits,
         CAST(round(value * 100) AS BIGINT) AS tokens
  FROM events WHERE event_type = 'click')"""


def service_sql(name: str) -> str:
    ev = dict((s, e) for e, s in td.SERVICE_OF_EVENT)[name]
    return (f"{name} AS (SELECT ts AS start_time, CAST(round(value * 100) AS BIGINT) * 1000000 AS e8 "
            f"FROM {EVENTS_CLASSIFIED} WHERE event_type = '{ev}' AND service_type = 'AI_SERVICES')")


FN_USAGE = """fn_usage AS (
  SELECT event_id AS query_id,
         CASE WHEN event_id % 7 = 5 THEN 'AI_EXTRACT' ELSE 'COMPLETE' END AS function_name,
         CAST(round(value * 100) AS BIGINT) * 1000000 AS e8, ts AS start_time
  FROM """ + EVENTS_CLASSIFIED + """ WHERE event_type = 'click' AND service_type = 'AI_SERVICES')"""

SEARCH_DAILY = """search_daily AS (
  SELECT CAST(ts AS DATE) AS usage_date, COUNT(*) AS requests,
         CAST(SUM(CAST(round(value * 100) AS BIGINT) * 1000000) AS DOUBLE) / 1e8 AS credits
  FROM """ + EVENTS_CLASSIFIED + """ WHERE event_type = 'purchase' AND service_type = 'AI_SERVICES'
  GROUP BY 1)"""

CAT = f"cat AS (SELECT * FROM {cat.catalog_values_sql('c')})"

RESULTS = f"""results AS (
  SELECT test, function || ' - logged run' AS test_type, model, function, response, input_tokens, output_tokens,
         latency_centi / 100.0 AS latency,
         CAST(e10 AS DOUBLE) / 1e10 AS cost, status, latency_centi, e10, session_id
  FROM (
    SELECT b.*, CASE WHEN status = 'success'
             THEN (input_tokens * in_centi + output_tokens * out_centi) * 300 ELSE 0 END AS e10
    FROM (
      SELECT l_orderkey AS session_id, l_returnflag || l_linestatus AS test,
             {_case('l_partkey % 8', td.MOD8_MODELS)} AS model,
             {_case('l_linenumber', td.LINE_FUNCTIONS)} AS function,
             repeat(l_linestatus, l_linenumber * 7) AS response,
             CAST(round(l_quantity * 100) AS BIGINT) AS input_tokens,
             CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_linenumber AS BIGINT) * 50 ELSE CAST(0 AS BIGINT) END AS output_tokens,
             CAST(CASE WHEN l_partkey % 50 <> 0 THEN l_suppkey % 100 + 1 ELSE 0 END AS BIGINT) AS latency_centi,
             CASE WHEN l_partkey % 50 <> 0 THEN 'success' ELSE 'error' END AS status
      FROM lineitem) b
    JOIN cat USING (model)) y)"""

# logged runs of the built-in functions beside the prompts (successful rows)
BUILTIN_RESULTS = f"""(
  SELECT {_case('l_partkey % 8', td.MOD8_MODELS)} AS model, {_case('l_linenumber', td.LINE_FUNCTIONS)} AS function,
         repeat('B', l_linenumber * 4) AS response, CAST(l_suppkey % 50 + 1 AS BIGINT) AS latency_centi
  FROM lineitem WHERE l_partkey % 50 <> 0 AND l_partkey % 8 <> 0) bi"""


def text_literal(s: str) -> str:
    """A string constant that may hold line feeds."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


RUNS = """runs AS (
  SELECT r.model, r.rows, CAST(r.input_tokens AS BIGINT) AS input_tokens,
         CAST(r.output_tokens AS BIGINT) AS output_tokens,
         CAST(r.input_tokens * c.in_centi + r.output_tokens * c.out_centi AS DOUBLE) / 1e8 AS total_credits,
         r.total_cost, r.time_seconds, r.sample_output, r.e10
  FROM (SELECT model, COUNT(*) AS rows,
               SUM(input_tokens) AS input_tokens, SUM(output_tokens) AS output_tokens,
               CAST(SUM(e10) AS DOUBLE) / 1e10 AS total_cost,
               CAST(SUM(latency_centi) AS DOUBLE) / 100.0 AS time_seconds,
               MIN(left(response, 500)) AS sample_output, SUM(e10) AS e10
        FROM results WHERE status = 'success' GROUP BY model) r
  JOIN cat c USING (model))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# -- look-backs and the usage / history join of the oracle queries -------------

def lookback(days) -> str:
    return f"TIMESTAMP '{td.AS_OF_ORDERS}' - INTERVAL {days} DAY"


def ev_lookback(days) -> str:
    return f"TIMESTAMP '{td.AS_OF_EVENTS}' - INTERVAL {days} DAY"


def joined(days: int, cols: str = "") -> str:
    """``FROM usage JOIN`` the query history of the look-back window."""
    return (f"FROM usage u JOIN (SELECT query_id{cols} FROM qh WHERE start_time >= "
            f"{lookback(days)}) q USING (query_id)")


# -- token estimates and cost expressions -------------------------------------

TOK_SQL = "greatest(1, length(text) // 4)"
IN_TOK_SQL = "CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END"
E8_SQL = "(input_tokens * in_centi + output_tokens * out_centi)"
ROUND2_SQL = f"CAST(round(CAST(CAST({E8_SQL} * 300 AS DOUBLE) / 1e10 AS DECIMAL(38,10)), 2) AS DOUBLE)"


def cost_sql(e8: str) -> str:
    """Raw credits and USD (at $3) of an exact 1e-8 credit expression."""
    return (f"CAST({e8} AS DOUBLE) / 1e8 AS total_credits_raw, "
            f"CAST(({e8}) * 300 AS DOUBLE) / 1e10 AS total_cost_usd_raw")


def cost9(in_: str, out_: str) -> str:
    """The 9-field cost record (rounded credits / USD plus raw twins)."""
    e = f"({in_} * in_centi + {out_} * out_centi)"
    r = "CAST(round(CAST({x} AS DECIMAL(38,10)), {d}) AS DOUBLE)"
    return ", ".join([
        r.format(x=f"CAST({in_} * in_centi AS DOUBLE) / 1e8", d=4) + " AS input_credits",
        r.format(x=f"CAST({out_} * out_centi AS DOUBLE) / 1e8", d=4) + " AS output_credits",
        r.format(x=f"CAST({e} AS DOUBLE) / 1e8", d=4) + " AS total_credits",
        r.format(x=f"CAST({in_} * in_centi * 300 AS DOUBLE) / 1e10", d=2) + " AS input_cost_usd",
        r.format(x=f"CAST({out_} * out_centi * 300 AS DOUBLE) / 1e10", d=2) + " AS output_cost_usd",
        r.format(x=f"CAST({e} * 300 AS DOUBLE) / 1e10", d=2) + " AS total_cost_usd",
        f"CAST({e} AS DOUBLE) / 1e8 AS total_credits_raw",
        f"CAST({e} * 300 AS DOUBLE) / 1e10 AS total_cost_usd_raw"])
