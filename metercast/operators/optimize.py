"""Optimization opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dimension
from .usage import expensive_groups

# The two rules of the optimization tab.
PREMIUM_MODELS = ["claude-3-5-sonnet", "claude-4-sonnet", "claude-4-opus",
                  "mistral-large2", "snowflake-llama-3.1-405b"]
SIMPLE_FUNCTIONS = ["SENTIMENT", "CLASSIFY_TEXT", "TRANSLATE"]
CHEAP_MODEL = "llama3.1-8b"
RULE2_FUNCTION = "COMPLETE"
RULE2_MIN_CALLS = 1000
RULE2_PATTERN = "llama3.1-70b"
RULE2_SAVINGS_PCT = 80.0


def opportunities(usage: DataFrame, qh: DataFrame, catalog: DataFrame, as_of, days: int = 30,
                  premium: list[str] = PREMIUM_MODELS, simple: list[str] = SIMPLE_FUNCTIONS,
                  cheap: str = CHEAP_MODEL, min_calls: int = RULE2_MIN_CALLS,
                  rule2_pct: float = RULE2_SAVINGS_PCT) -> DataFrame:
    """Model-switch opportunities over the (model, function) groups.

    Rule 1: a premium model (substring match) on a simple function, with
    both it and the cheap model in the catalog; saving on the input rate.
    Rule 2: COMPLETE with more than ``min_calls`` calls on a model containing
    'llama3.1-70b'; a flat ``rule2_pct`` saving. A group can fire both.
    """
    g = expensive_groups(usage, qh, as_of, days)
    return opportunities_from_groups(g, catalog, premium, simple, cheap, min_calls, rule2_pct)


def opportunities_from_groups(g: DataFrame, catalog: DataFrame,
                              premium: list[str] = PREMIUM_MODELS,
                              simple: list[str] = SIMPLE_FUNCTIONS, cheap: str = CHEAP_MODEL,
                              min_calls: int = RULE2_MIN_CALLS,
                              rule2_pct: float = RULE2_SAVINGS_PCT) -> DataFrame:
    """Both rules in one pass over the grouped rows: each group meets the
    broadcast rates of its own and of the cheap model, and emits 0, 1 or 2
    rule rows through ``explode`` (no second scan, no union of two plans).
    Order: the groups by credits (descending), rule 1 before rule 2."""
    rates = dimension(catalog.select(F.col("model").alias("model_name"),
                                       F.col("input_credits").alias("current_rate")), of=catalog)
    cheap_rate = dimension(catalog.where(F.col("model") == cheap)
                             .select(F.col("input_credits").alias("cheap_rate")), of=catalog)
    j = g.join(rates, "model_name", "left").join(cheap_rate, F.lit(True), "left")
    is_premium = F.exists(F.array(*[F.lit(p) for p in premium]),
                          lambda p: F.col("model_name").contains(p))
    fires1 = (is_premium & F.col("function_name").isin(list(simple))
              & (F.col("current_rate") > 0) & F.col("cheap_rate").isNotNull())
    fires2 = ((F.col("function_name") == RULE2_FUNCTION) & (F.col("call_count") > min_calls)
              & F.col("model_name").contains(RULE2_PATTERN))
    # a model at no cost can't get cheaper
    pct1 = (F.lit(1.0) - F.try_divide("cheap_rate", "current_rate")) * F.lit(100.0)

    def rule(n: int, fires, savings, pct):
        return F.when(fires, F.struct(F.lit(n).alias("rule"), savings.alias("potential_savings"),
                                      pct.alias("savings_pct")))

    rules = F.array(
        rule(1, fires1, F.col("total_credits") * (pct1 / F.lit(100.0)), pct1),
        rule(2, fires2, F.col("total_credits") * F.lit(rule2_pct / 100.0), F.lit(float(rule2_pct))))
    hits = j.select("*", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("_r"))
    return (hits.select(F.col("_r.rule").alias("rule"), F.col("model_name").alias("current"),
                        F.lit(cheap).alias("recommended"), F.col("function_name").alias("function"),
                        F.col("call_count").alias("calls"), F.col("total_credits").alias("current_credits"),
                        F.col("_r.potential_savings").alias("potential_savings"),
                        F.col("_r.savings_pct").alias("savings_pct"),
                        F.lit("model_switch").alias("type"))
              .orderBy(F.desc("current_credits"), "current", "function", "rule"))


def total_savings(opps: DataFrame, price: float = 3.0) -> DataFrame:
    """Total potential savings in credits and USD (A21), rounded half-up to
    6 and 4 decimals so the figure does not depend on summation order."""
    from ..functions import money
    t = F.coalesce(F.sum("potential_savings"), F.lit(0.0))
    return opps.agg(money.round_half_up(t, 6).alias("total_savings"),
                    money.round_half_up(t * F.lit(price), 4).alias("total_savings_usd"),
                    F.count(F.lit(1)).alias("opportunities"))
