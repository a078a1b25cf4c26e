"""Usage analytics over function-usage logs, query history and metering
(C7, C9, C12, C15, C16, C17, C32 / S2-S6, A1-A9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money
from .common import credit_e8, model_label, since, since_date, top_k, with_history


# -- C9 model & function analysis ---------------------------------------------

def model_function_groups(usage: DataFrame, qh: DataFrame, as_of, days: int = 30,
                          label: str = "Specialized Function") -> DataFrame:
    """A3 with the exact credit sum kept (``credits_e8``) for roll-ups."""
    j = with_history(usage, qh, as_of, days)
    return (j.groupBy(model_label("model_name", label).alias("model_name"), "function_name")
             .agg(F.count(F.lit(1)).alias("invocations"),
                  F.sum("tokens").alias("total_tokens"),
                  money.exact_sum(credit_e8(j, "token_credits")).alias("credits_e8")))


def _per_call(g: DataFrame, n: str, tok: str = "total_tokens") -> list:
    return [(F.col(tok).cast("double") / F.col(n)).alias("avg_tokens_per_call"),
            (F.col("total_credits") / F.col(n)).alias("avg_credits_per_call")]


def model_analysis(usage: DataFrame, qh: DataFrame, as_of, days: int = 30,
                   label: str = "Specialized Function") -> DataFrame:
    """Per (model, function): invocations, tokens, credits and per-call means,
    most expensive first."""
    return analysis_of_groups(model_function_groups(usage, qh, as_of, days, label))


def analysis_of_groups(g: DataFrame) -> DataFrame:
    """The report of :func:`model_analysis` from its (model, function) groups."""
    g = g.withColumn("total_credits", money.e8_to_credits("credits_e8"))
    return (g.select("model_name", "function_name", "invocations", "total_tokens",
                     "total_credits", *_per_call(g, "invocations"))
             .orderBy(F.desc_nulls_last("total_credits"), "model_name", "function_name"))


def rollup(groups: DataFrame, by: list[str]) -> DataFrame:
    """Roll (model, function) groups up to ``by`` (A4, A5; ``by=[]`` is A6).
    Works on the small grouped frame, re-summing the exact credits."""
    agg = [F.sum("invocations").alias("invocations"),
           F.sum("total_tokens").alias("total_tokens"),
           money.credits_sum("credits_e8").alias("total_credits")]
    out = groups.groupBy(*by).agg(*agg) if by else groups.agg(*agg)
    if not by:
        out = out.select(
            F.coalesce(F.col("invocations"), F.lit(0).cast("long")).alias("total_invocations"),
            F.coalesce(F.col("total_tokens"), F.lit(0).cast("long")).alias("total_tokens"),
            F.coalesce(F.col("total_credits"), F.lit(0.0)).alias("total_credits"),
            money.safe_div(F.col("total_tokens").cast("double"), F.col("invocations"))
                 .alias("avg_tokens_per_call"))
        return out
    return out.orderBy(F.desc_nulls_last("total_credits"), *by)


def usage_rollups(usage: DataFrame, qh: DataFrame, as_of, days: int = 30,
                  label: str = "Specialized Function") -> DataFrame:
    """All four levels of the model & function analysis in one pass (A3-A6):
    (model, function), model, function and the grand total, as grouping
    sets over one scan and one shuffle. ``level`` names the grouping;
    rolled-up columns are NULL."""
    j = with_history(usage, qh, as_of, days)
    j = j.select(model_label("model_name", label).alias("model_name"), "function_name", "tokens",
                 credit_e8(j, "token_credits").alias("_e8"))
    m, f = F.col("model_name"), F.col("function_name")
    g = j.groupingSets([[m, f], [m], [f], []], m, f).agg(
        F.grouping_id(m, f).alias("_gid"),
        F.count(F.lit(1)).alias("invocations"),
        F.sum("tokens").alias("total_tokens"),
        money.credits_sum("_e8").alias("total_credits"))
    level = (F.when(F.col("_gid") == 0, F.lit("model_function"))
              .when(F.col("_gid") == 1, F.lit("model"))
              .when(F.col("_gid") == 2, F.lit("function"))
              .otherwise(F.lit("total")))
    return g.select(level.alias("level"), "model_name", "function_name", "invocations",
                    "total_tokens", "total_credits",
                    (F.col("total_tokens").cast("double") / F.col("invocations")).alias("avg_tokens_per_call"))


# -- C15 / C16 / C17 ----------------------------------------------------------

def top_expensive_queries(usage: DataFrame, qh: DataFrame, as_of, days: int = 7,
                          limit: int = 50) -> DataFrame:
    """The ``limit`` most expensive calls with query details.

    Details are wide (query text), so they are fetched late: the narrow calls
    of the window give the credits of the ``limit``-th one (a two-level top-k,
    one row); only calls of at least that many credits, ties included, meet
    the history's details."""
    calls = usage.select("query_id", "function_name", "model_name", "tokens", "token_credits")
    credits = with_history(calls.select("query_id", "token_credits"), qh, as_of, days).select("token_credits")
    # one row by construction (a global aggregate)
    bound = top_k(credits, [F.desc_nulls_last("token_credits")], limit).agg(
        F.when(F.count("token_credits") == limit, F.min("token_credits")).alias("_least"))
    few = calls.join(F.broadcast(bound), F.col("_least").isNull() | (F.col("token_credits") >= F.col("_least"))).drop("_least")
    j = with_history(few, qh, as_of, days,
                     cols=("query_text", "start_time", "execution_time", "user_name",
                           "warehouse_name", "role_name"))
    out = j.select("query_id",
                   F.left(F.col("query_text"), F.lit(200)).alias("query_text"),
                   "start_time",
                   (F.col("execution_time") / F.lit(1000)).alias("execution_seconds"),
                   "function_name", "model_name", "tokens", "token_credits",
                   "user_name", "warehouse_name", "role_name")
    order = [F.desc_nulls_last("token_credits")] + [F.asc_nulls_last(c) for c in out.columns
                                                    if c != "token_credits"]
    return top_k(out, order, limit)


def usage_by_user(usage: DataFrame, qh: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Per (user, model): query count, tokens, credits."""
    j = with_history(usage, qh, as_of, days, cols=("user_name",))
    return (j.groupBy("user_name", "model_name")
             .agg(F.count(F.lit(1)).alias("query_count"),
                  F.sum("tokens").alias("total_tokens"),
                  money.credits_sum(credit_e8(j, "token_credits")).alias("total_credits"))
             .orderBy(F.desc_nulls_last("total_credits"), "user_name", "model_name"))


def usage_by_function(usage: DataFrame, qh: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Per (function, model): count, tokens, credits, mean tokens."""
    j = with_history(usage, qh, as_of, days)
    g = j.groupBy("function_name", "model_name").agg(
        F.count(F.lit(1)).alias("invocation_count"),
        F.sum("tokens").alias("total_tokens"),
        money.credits_sum(credit_e8(j, "token_credits")).alias("total_credits"))
    return (g.withColumn("avg_tokens_per_call",
                         F.col("total_tokens").cast("double") / F.col("invocation_count"))
             .orderBy(F.desc_nulls_last("total_credits"), "function_name", "model_name"))


# -- A9 / C12 -----------------------------------------------------------------

def expensive_groups(usage: DataFrame, qh: DataFrame, as_of, days: int = 30,
                     label: str = "Specialized", min_credits: float = 0.001) -> DataFrame:
    """Per (model label, function): calls, tokens, credits with
    ``HAVING credits > min_credits`` (A9)."""
    j = with_history(usage, qh, as_of, days)
    g = (j.groupBy(model_label("model_name", label).alias("model_name"), "function_name")
          .agg(F.count(F.lit(1)).alias("call_count"),
               F.sum("tokens").alias("total_tokens"),
               money.exact_sum(credit_e8(j, "token_credits")).alias("credits_e8")))
    g = g.withColumn("total_credits", money.e8_to_credits("credits_e8"))
    return g.where(F.col("total_credits") > F.lit(min_credits))


def efficiency(usage: DataFrame, qh: DataFrame, as_of, days: int = 30, n: int = 10) -> DataFrame:
    """Tokens per credit of the ``n`` most expensive groups."""
    g = expensive_groups(usage, qh, as_of, days)
    den = F.when(F.col("total_credits") == 0, F.lit(1.0)).otherwise(F.col("total_credits"))
    return (g.select("model_name", "function_name", "call_count", "total_tokens", "total_credits",
                     (F.col("total_tokens") / den).alias("efficiency"))
             .orderBy(F.desc_nulls_last("total_credits"), "model_name", "function_name")
             .limit(n))


# -- C7 usage overview over metering ---------------------------------------------

def daily_usage(metering: DataFrame, as_of, days: int = 30,
                service_type: str | None = "AI_SERVICES", ordered: bool = True) -> DataFrame:
    """Daily credits per service type (A1), oldest first. ``ordered=False``
    leaves out the final sort when the series feeds another operator."""
    m = metering.where(since(metering, "start_time", as_of, days))
    if service_type is not None:
        m = m.where(F.col("service_type") == service_type)
    g = (m.groupBy(F.to_date("start_time").alias("usage_date"), "service_type")
          .agg(money.credits_sum(credit_e8(m, "credits_used")).alias("credits")))
    return g.orderBy("usage_date", "service_type") if ordered else g


def usage_overview(metering: DataFrame, as_of, days: int = 30, price: float = 3.0,
                   service_type: str = "AI_SERVICES") -> DataFrame:
    """One row of KPIs: total credits, cost, average per requested day and
    its 30-day projection (C7, A20). The divisor is ``days``, not the number
    of days observed."""
    m = metering.where(since(metering, "start_time", as_of, days)
                       & (F.col("service_type") == service_type))
    return overview_of_sum(m.agg(money.exact_sum(credit_e8(m, "credits_used")).alias("e8")), days, price)


def overview_of_sum(g: DataFrame, days: int, price: float) -> DataFrame:
    """The row of :func:`usage_overview` from the exact sum ``e8`` of its window (null: nothing used)."""
    g = g.select(F.coalesce(F.col("e8"), F.lit(0)).cast(money.SUM_TYPE).alias("e8"))
    total = money.e8_to_credits("e8")
    avg_daily = total / F.lit(float(days))
    return g.select(total.alias("total_credits"),
                    money.e10_to_usd(F.col("e8") * F.lit(money.price_centi(price))).alias("total_cost"),
                    avg_daily.alias("avg_daily_credits"),
                    (avg_daily * F.lit(30.0)).alias("projected_monthly_credits"))


# -- C32 listings (S2-S6) -------------------------------------------------------

def daily_service_usage(metering_daily: DataFrame, as_of, days: int = 30,
                        service_type: str = "AI_SERVICES") -> DataFrame:
    return (metering_daily
            .where((F.col("service_type") == service_type) & since_date("usage_date", as_of, days))
            .select("usage_date", "service_type", "credits_used", "credits_used_compute",
                    "credits_used_cloud_services")
            .orderBy(F.desc("usage_date"), *[F.asc_nulls_last(c) for c in ("credits_used", "credits_used_compute",
                                                                           "credits_used_cloud_services")]))


def hourly_function_usage(usage_hourly: DataFrame, as_of, days: int = 7) -> DataFrame:
    return (usage_hourly.where(since(usage_hourly, "start_time", as_of, days))
            .select("start_time", "end_time", "function_name", "model_name", "warehouse_id",
                    "token_credits", "tokens")
            # an hour may hold a third of all rows: ties are broken, so that the range can be cut inside it
            .orderBy(F.desc("start_time"), "function_name", "model_name", "warehouse_id", "tokens", "token_credits"))


def top_query_usage(usage: DataFrame, limit: int = 1000) -> DataFrame:
    """The ``limit`` largest calls by credits (S4; no time filter)."""
    out = usage.select("query_id", "function_name", "model_name", "tokens", "token_credits")
    return top_k(out, [F.desc_nulls_last("token_credits"),
                       *[F.asc_nulls_last(c) for c in out.columns if c != "token_credits"]], limit)


def search_usage(search_daily: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _latest_first(search_daily.where(since_date("usage_date", as_of, days)), "usage_date")


def analyst_usage(analyst: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _latest_first(analyst.where(since(analyst, "start_time", as_of, days)), "start_time")


def _latest_first(df: DataFrame, time_col: str) -> DataFrame:
    """Newest rows first; rows of one time by their other columns, so that a
    time that holds a third of all rows is cut over several sort ranges."""
    return df.orderBy(F.desc(time_col), *[F.asc_nulls_last(c) for c in df.columns if c != time_col])


# -- A16 ---------------------------------------------------------------------------

def distinct_users(usage: DataFrame, qh: DataFrame, as_of, days: int = 30) -> DataFrame:
    """(model_name, users): how many users called each model, exactly. The
    estimate from merged daily sketches is ``rollups.UsageRollups.distinct_users``."""
    j = with_history(usage, qh, as_of, days, cols=("user_name",)).where("user_name is not null")
    return j.select("model_name", "user_name").distinct().groupBy("model_name").agg(F.count(F.lit(1)).alias("users"))
