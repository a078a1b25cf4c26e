"""Registered queries over the function-usage log and the query history
(C4, C6, C9, C11, C12, C15-C17, C33, S4, A3-A9, A21)."""

from __future__ import annotations

import uuid

from ..operators import catalog_ops as CO
from ..operators import costing as C
from ..operators import optimize as O
from ..operators import usage as U
from ..session import ensure_checkpoint_dir
from ..sources import catalog as CAT
from ..sources import readers as RD
from ..sources.testdata import AS_OF_ORDERS
from . import fixtures_sql as X
from .registry import ORACLE, register, td


# --- C9 and its roll-ups (A3-A6) ------------------------------------------------

MA_DAYS = 90


@register("model_analysis", X.with_(X.USAGE, X.QH) + f"""
SELECT COALESCE(NULLIF(model_name, ''), 'Specialized Function') AS model_name, function_name,
       COUNT(*) AS invocations, CAST(SUM(tokens) AS BIGINT) AS total_tokens,
       {X.SUM_CREDITS} AS total_credits,
       CAST(SUM(tokens) AS DOUBLE) / COUNT(*) AS avg_tokens_per_call,
       ({X.SUM_CREDITS}) / COUNT(*) AS avg_credits_per_call
{X.joined(MA_DAYS)}
GROUP BY 1, 2""")
def q_model_analysis(spark, sf_dir):
    t = td(spark, sf_dir)
    return U.model_analysis(t.usage(), t.query_history(users=False), AS_OF_ORDERS, MA_DAYS)


_GROUPS = X.with_(X.USAGE, X.QH, f"""g AS (
SELECT COALESCE(NULLIF(model_name, ''), 'Specialized Function') AS model_name, function_name,
       COUNT(*) AS invocations, CAST(SUM(tokens) AS BIGINT) AS total_tokens, SUM(tokens * rate_centi) AS e8
{X.joined(MA_DAYS)} GROUP BY 1, 2)""")


def _groups(spark, sf_dir):
    t = td(spark, sf_dir)
    return U.model_function_groups(t.usage(), t.query_history(users=False), AS_OF_ORDERS, MA_DAYS)


@register("model_rollup", _GROUPS + """
SELECT model_name, CAST(SUM(invocations) AS BIGINT) AS invocations,
       CAST(SUM(total_tokens) AS BIGINT) AS total_tokens,
       CAST(SUM(e8) AS DOUBLE) / 1e8 AS total_credits
FROM g GROUP BY model_name""")
def q_model_rollup(spark, sf_dir):
    return U.rollup(_groups(spark, sf_dir), ["model_name"])


@register("function_rollup", _GROUPS + """
SELECT function_name, CAST(SUM(invocations) AS BIGINT) AS invocations,
       CAST(SUM(total_tokens) AS BIGINT) AS total_tokens,
       CAST(SUM(e8) AS DOUBLE) / 1e8 AS total_credits
FROM g GROUP BY function_name""")
def q_function_rollup(spark, sf_dir):
    return U.rollup(_groups(spark, sf_dir), ["function_name"])


@register("usage_totals", _GROUPS + """
SELECT CAST(COALESCE(SUM(invocations), 0) AS BIGINT) AS total_invocations,
       CAST(COALESCE(SUM(total_tokens), 0) AS BIGINT) AS total_tokens,
       COALESCE(CAST(SUM(e8) AS DOUBLE) / 1e8, 0.0) AS total_credits,
       CASE WHEN SUM(invocations) > 0
            THEN CAST(SUM(total_tokens) AS DOUBLE) / SUM(invocations) ELSE 0.0 END AS avg_tokens_per_call
FROM g""")
def q_usage_totals(spark, sf_dir):
    return U.rollup(_groups(spark, sf_dir), [])


# --- C15 / C16 / C17 / S4 -----------------------------------------------------

USER_DAYS = 90


@register("top_expensive_queries", X.with_(X.USAGE, X.QH) + f"""
SELECT query_id, left(query_text, 200) AS query_text, start_time,
       execution_time / 1000 AS execution_seconds, function_name, model_name, tokens,
       {X.TOKEN_CREDITS} AS token_credits, user_name, warehouse_name, role_name
{X.joined(7, ', query_text, start_time, execution_time, user_name, warehouse_name, role_name')}
ORDER BY token_credits DESC NULLS LAST, query_id, query_text, start_time, execution_seconds,
         function_name, model_name, tokens, user_name, warehouse_name, role_name
LIMIT 50""")
def q_top_expensive_queries(spark, sf_dir):
    t = td(spark, sf_dir)
    return U.top_expensive_queries(t.usage(), t.query_history(), AS_OF_ORDERS, 7, 50)


@register("usage_by_user", X.with_(X.USAGE, X.QH) + f"""
SELECT user_name, model_name, COUNT(*) AS query_count, CAST(SUM(tokens) AS BIGINT) AS total_tokens,
       {X.SUM_CREDITS} AS total_credits
{X.joined(USER_DAYS, ', user_name')}
GROUP BY user_name, model_name""")
def q_usage_by_user(spark, sf_dir):
    t = td(spark, sf_dir)
    return U.usage_by_user(t.usage(), t.query_history(), AS_OF_ORDERS, USER_DAYS)


@register("usage_by_function", X.with_(X.USAGE, X.QH) + f"""
SELECT function_name, model_name, COUNT(*) AS invocation_count, CAST(SUM(tokens) AS BIGINT) AS total_tokens,
       {X.SUM_CREDITS} AS total_credits,
       CAST(SUM(tokens) AS DOUBLE) / COUNT(*) AS avg_tokens_per_call
{X.joined(USER_DAYS)}
GROUP BY function_name, model_name""")
def q_usage_by_function(spark, sf_dir):
    t = td(spark, sf_dir)
    return U.usage_by_function(t.usage(), t.query_history(users=False), AS_OF_ORDERS, USER_DAYS)


@register("usage_by_function_from_log", ORACLE["usage_by_function"])
def q_usage_by_function_from_log(spark, sf_dir):
    """The same report over a written usage table and query history, both
    read back by the usage-table readers (S1-S7, S15)."""
    t = td(spark, sf_dir)
    folder = f"{ensure_checkpoint_dir(spark)}/usage-log-{uuid.uuid4().hex}"
    t.usage().select("query_id", "function_name", "model_name", "tokens", "token_credits").write.parquet(f"{folder}/usage")
    t.query_history().write.parquet(f"{folder}/history")
    return U.usage_by_function(RD.read_usage(spark, f"{folder}/usage", "usage"),
                               RD.read_usage(spark, f"{folder}/history", "query_history"), AS_OF_ORDERS, USER_DAYS)


@register("top_query_usage", X.with_(X.USAGE) + f"""
SELECT query_id, function_name, model_name, tokens, {X.TOKEN_CREDITS} AS token_credits
FROM usage
ORDER BY token_credits DESC NULLS LAST, query_id, function_name, model_name, tokens
LIMIT 1000""")
def q_top_query_usage(spark, sf_dir):
    return U.top_query_usage(td(spark, sf_dir).usage(), 1000)


@register("efficiency_top10", X.with_(X.USAGE, X.QH) + f"""
SELECT model_name, function_name, call_count, total_tokens, total_credits,
       total_tokens / CASE WHEN total_credits = 0 THEN 1.0 ELSE total_credits END AS efficiency
FROM (SELECT COALESCE(NULLIF(model_name, ''), 'Specialized') AS model_name, function_name,
             COUNT(*) AS call_count, CAST(SUM(tokens) AS BIGINT) AS total_tokens, {X.SUM_CREDITS} AS total_credits
      {X.joined(MA_DAYS)} GROUP BY 1, 2) g
WHERE total_credits > 0.001
ORDER BY total_credits DESC, model_name, function_name
LIMIT 10""")
def q_efficiency_top10(spark, sf_dir):
    t = td(spark, sf_dir)
    return U.efficiency(t.usage(), t.query_history(users=False), AS_OF_ORDERS, MA_DAYS, 10)


# --- C11 opportunities -----------------------------------------------------------------

OPP_DAYS = 3650
_PREMIUM_SQL = " OR ".join(f"contains(g.model_name, '{p}')" for p in O.PREMIUM_MODELS)
_SIMPLE_SQL = ", ".join(f"'{f}'" for f in O.SIMPLE_FUNCTIONS)


@register("opportunities", X.with_(X.USAGE, X.QH, X.CAT, f"""g AS (
  SELECT * FROM (
    SELECT COALESCE(NULLIF(model_name, ''), 'Specialized') AS model_name, function_name,
           COUNT(*) AS call_count, {X.SUM_CREDITS} AS total_credits
    {X.joined(OPP_DAYS)} GROUP BY 1, 2) t WHERE total_credits > 0.001)""") + f"""
SELECT 1 AS rule, g.model_name AS current, 'llama3.1-8b' AS recommended, function_name AS function,
       call_count AS calls, total_credits AS current_credits,
       total_credits * (((1.0 - ch.input_credits / c.input_credits) * 100.0) / 100.0) AS potential_savings,
       (1.0 - ch.input_credits / c.input_credits) * 100.0 AS savings_pct, 'model_switch' AS type
FROM g JOIN cat c ON c.model = g.model_name
CROSS JOIN (SELECT input_credits FROM cat WHERE model = 'llama3.1-8b') ch
WHERE ({_PREMIUM_SQL}) AND function_name IN ({_SIMPLE_SQL})
UNION ALL
SELECT 2, g.model_name, 'llama3.1-8b', function_name, call_count, total_credits,
       total_credits * 0.8, 80.0, 'model_switch'
FROM g WHERE function_name = 'COMPLETE' AND call_count > 1000 AND contains(g.model_name, 'llama3.1-70b')""")
def q_opportunities(spark, sf_dir):
    t = td(spark, sf_dir)
    return O.opportunities(t.usage(), t.query_history(users=False), CAT.load_catalog(spark),
                           AS_OF_ORDERS, OPP_DAYS)


# --- C4 / C6 / C33 over the usage log ---------------------------------------------------

@register("spend_by_provider_tier", X.with_(X.USAGE, X.QH, X.CAT) + f"""
SELECT provider, category AS tier, supports_vision, available, COUNT(*) AS calls,
       CAST(SUM(tokens) AS BIGINT) AS total_tokens, {X.SUM_CREDITS} AS total_credits,
       COUNT(DISTINCT model_name) AS models
{X.joined(MA_DAYS)} LEFT JOIN cat ON cat.model = u.model_name
GROUP BY provider, category, supports_vision, available""")
def q_spend_by_provider_tier(spark, sf_dir):
    t = td(spark, sf_dir)
    return CO.spend_by_catalog_attr(t.usage(), t.query_history(users=False), CAT.load_catalog(spark),
                                    AS_OF_ORDERS, MA_DAYS)


def _mft_sql(literal: bool) -> str:
    if literal:
        m = "m AS (SELECT DISTINCT task, model FROM (SELECT DISTINCT task FROM tc) x CROSS JOIN cat)"
    else:
        m = ("mc AS (SELECT DISTINCT model, task_category FROM bf JOIN kw ON contains(lower(use_case), keyword)),\n"
             "m AS (SELECT DISTINCT task, model FROM tc JOIN mc USING (task_category))")
    return X.with_(X.USAGE, X.CAT, f"bf AS (SELECT * FROM {CAT.best_for_values_sql('b')})",
                   f"kw AS (SELECT * FROM {CAT.keywords_values_sql('k')})",
                   "t AS (SELECT DISTINCT function_name AS task FROM usage WHERE function_name IS NOT NULL)",
                   "tc AS (SELECT DISTINCT task, task_category FROM t JOIN kw ON contains(lower(task), keyword))",
                   m,
                   """fb AS (SELECT task, model FROM t
           CROSS JOIN (SELECT model FROM cat ORDER BY input_credits, pos LIMIT 5) ch
           WHERE task NOT IN (SELECT task FROM m))""",
                   """a AS (SELECT task, model, FALSE AS fallback FROM m
          UNION ALL SELECT task, model, TRUE FROM fb)""") + """
SELECT task, model, input_credits, fallback,
       row_number() OVER (PARTITION BY task ORDER BY input_credits, pos) AS rank
FROM a JOIN cat USING (model)"""


@register("models_for_task", _mft_sql(False))
def q_models_for_task(spark, sf_dir):
    from pyspark.sql import functions as F
    tasks = td(spark, sf_dir).usage().select(F.col("function_name").alias("task"))
    return CO.models_for_task(tasks, CAT.load_catalog(spark), CAT.load_task_keywords(spark))


@register("models_for_task_literal", _mft_sql(True))
def q_models_for_task_literal(spark, sf_dir):
    from pyspark.sql import functions as F
    tasks = td(spark, sf_dir).usage().select(F.col("function_name").alias("task"))
    return CO.models_for_task(tasks, CAT.load_catalog(spark), CAT.load_task_keywords(spark),
                              literal=True)


_SERVICES = list(enumerate([n for n, _r, _u in CAT.SERVICE_RATES], start=1))


@register("service_rate_cost", f"""
SELECT name, units, 'service' AS kind, unit, r AS credits_per_unit,
       CAST(round(CAST(units AS DECIMAL(28,12)) * CAST(round(r * 100) AS BIGINT) * (1000000 // per_units), 0) AS DOUBLE) / 1e8 AS credits
FROM (SELECT {X._case('l_linenumber', _SERVICES)} AS name, CAST(SUM(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 8 AS units
      FROM lineitem WHERE l_linenumber <= {len(_SERVICES)} GROUP BY 1) u
JOIN (VALUES """ + ", ".join(f"('{n}', CAST({r} AS DOUBLE), '{u}', {CAT._per_units(u)})" for n, r, u in CAT.SERVICE_RATES)
          + """) v(name, r, unit, per_units) USING (name)""")
def q_service_rate_cost(spark, sf_dir):
    """Messages, GB-months, pages and hours at their list rates."""
    return C.rate_list_cost(td(spark, sf_dir).service_units(), CAT.load_rates(spark))


@register("function_rate_cost", X.with_(X.USAGE, f"rates AS (SELECT * FROM {CAT.rates_values_sql('function', 'r')})") + """
SELECT function_name, COUNT(*) AS calls, CAST(SUM(tokens) AS BIGINT) AS tokens,
       MAX(credits_per_unit) AS rate_credits_per_1m,
       CAST(SUM(tokens * rates.rate_centi) AS DOUBLE) / 1e8 AS rate_credits
FROM usage LEFT JOIN rates ON rates.name = usage.function_name
GROUP BY function_name""")
def q_function_rate_cost(spark, sf_dir):
    return C.function_cost(td(spark, sf_dir).usage(), CAT.load_rates(spark, "function"))


# --- A21 total potential savings ---------------------------------------------------------

@register("opportunity_savings_total", "WITH o AS (" + ORACLE["opportunities"] + """)
SELECT CAST(round(CAST(COALESCE(SUM(potential_savings), 0.0) AS DECIMAL(38,10)), 6) AS DOUBLE) AS total_savings,
       CAST(round(CAST(COALESCE(SUM(potential_savings), 0.0) * 3.0 AS DECIMAL(38,10)), 4) AS DOUBLE) AS total_savings_usd,
       COUNT(*) AS opportunities
FROM o""")
def q_opportunity_savings_total(spark, sf_dir):
    return O.total_savings(q_opportunities(spark, sf_dir))


# --- A3-A6 in one pass: grouping sets ---------------------------------------------------

@register("usage_rollups", X.with_(X.USAGE, X.QH) + f"""
SELECT CASE grouping(model_name, function_name) WHEN 0 THEN 'model_function' WHEN 1 THEN 'model'
            WHEN 2 THEN 'function' ELSE 'total' END AS level,
       model_name, function_name, COUNT(*) AS invocations, CAST(SUM(tokens) AS BIGINT) AS total_tokens,
       {X.SUM_CREDITS} AS total_credits, CAST(SUM(tokens) AS DOUBLE) / COUNT(*) AS avg_tokens_per_call
FROM (SELECT COALESCE(NULLIF(model_name, ''), 'Specialized Function') AS model_name, function_name,
             tokens, rate_centi
      {X.joined(MA_DAYS)}) j
GROUP BY GROUPING SETS ((model_name, function_name), (model_name), (function_name), ())""")
def q_usage_rollups(spark, sf_dir):
    t = td(spark, sf_dir)
    return U.usage_rollups(t.usage(), t.query_history(users=False), AS_OF_ORDERS, MA_DAYS)
