"""Operators that use the price catalog as a dimension (C4, C6, T4,
P11-P15, P19, P21, A22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import money
from .common import DIM_MAX_ROWS, credit_e8, dimension, with_history


# -- P11-P15 filters, T4, A22 ----------------------------------------------------

def by_provider(catalog: DataFrame, provider: str) -> DataFrame:
    return catalog.where(F.col("provider") == provider)


def available_models(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("available"))


def by_tier(catalog: DataFrame, tier: str) -> DataFrame:
    return catalog.where(F.col("category") == tier)


def allowed_models(catalog: DataFrame, allowed: DataFrame | list[str]) -> DataFrame:
    """Selected ∩ known (P14): a semi join against an allow-list."""
    if isinstance(allowed, DataFrame):
        return catalog.join(dimension(allowed.select("model"), of=allowed), "model", "left_semi")
    return catalog.where(F.col("model").isin(list(allowed)))


def tier_members(catalog: DataFrame, tiers: DataFrame, tier: str | None = None) -> DataFrame:
    """Named tier ∩ catalog (P15); ``tier=None`` keeps every tier."""
    t = tiers if tier is None else tiers.where(F.col("tier") == tier)
    return t.join(catalog, "model", "inner")


def cheapest_models(catalog: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` cheapest models by input price, catalog order on ties (T4)."""
    return catalog.orderBy("input_credits", "pos").limit(n)


# Sort options of the catalog view (key, descending).
CATALOG_SORTS = {
    "Input Price (Low→High)": ("input_credits", False),
    "Input Price (High→Low)": ("input_credits", True),
    "Provider": ("provider", False),
    "Model Name": ("model", False),
}


def sort_catalog(catalog: DataFrame, by: str = "Input Price (Low→High)") -> DataFrame:
    """The catalog in one of the view's sort orders (T8); ties keep catalog
    order."""
    key, desc = CATALOG_SORTS[by]
    return catalog.orderBy(F.col(key).desc() if desc else F.col(key).asc(), "pos")


def providers(catalog: DataFrame) -> DataFrame:
    """Distinct providers, sorted."""
    return catalog.select("provider").distinct().orderBy("provider")


def catalog_view(catalog: DataFrame, price: float = 3.0, selected: list[str] | None = None) -> DataFrame:
    """Display projection (P19-P21): USD per 1M tokens at ``price``, title
    tier, first two use cases, vision / availability marks."""
    sel = F.lit(False) if selected is None else F.col("model").isin(list(selected))
    return catalog.select(
        "pos", "model", "provider", F.initcap("category").alias("tier"),
        "input_credits", "output_credits",
        (F.col("input_credits") * F.lit(price)).alias("input_usd_per_1m"),
        (F.col("output_credits") * F.lit(price)).alias("output_usd_per_1m"),
        "context_window",
        F.concat_ws(", ", F.slice("best_for", 1, 2)).alias("best_for"),
        F.when(F.col("supports_vision"), F.lit("vision")).otherwise(F.lit("")).alias("vision"),
        F.when(F.col("available"), F.lit("available")).otherwise(F.lit("limited")).alias("availability"),
        sel.alias("selected"))


# -- C4 spend by catalog attributes -------------------------------------------------

def spend_by_catalog_attr(usage: DataFrame, qh: DataFrame, catalog: DataFrame, as_of,
                          days: int = 30, allowed: list[str] | None = None) -> DataFrame:
    """Usage enriched with the catalog (left join on the model name, so blank
    and unknown models form their own NULL group) and grouped by provider,
    tier, vision and availability."""
    j = with_history(usage, qh, as_of, days)
    if allowed is not None:
        j = j.where(F.col("model_name").isin(list(allowed)))
    c = dimension(catalog.select(F.col("model").alias("model_name"), "provider",
                                 F.col("category").alias("tier"), "supports_vision", "available"),
                  of=catalog)
    e = j.join(c, "model_name", "left")
    return (e.groupBy("provider", "tier", "supports_vision", "available")
             .agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("total_tokens"),
                  money.credits_sum(credit_e8(e, "token_credits")).alias("total_credits"),
                  F.countDistinct("model_name").alias("models"))
             .orderBy(F.desc_nulls_last("total_credits")))


# -- C6 recommended models per task ------------------------------------------------

def models_for_task(tasks: DataFrame, catalog: DataFrame, keywords: DataFrame,
                    task_col: str = "task", k: int = 5, literal: bool = False) -> DataFrame:
    """Ranked recommended models per distinct task of a log.

    Default (intent): a model matches when one of its use cases contains a
    keyword of a category that has a keyword in the task. ``literal=True``
    reproduces the shipped behaviour where any keyword in the task matches
    every model. Tasks with no match fall back to the ``k`` cheapest models.
    Ranking: input price, then catalog order.

    Plan: one scan and one shuffle. The task column is reduced to distinct
    values (partial aggregation, hash-partitioned by task); every later join
    broadcasts a dimension of fixed size (keywords, catalog), so the task
    partitioning carries through to the per-task grouping and the ranking
    window. A task's model set is bounded by the catalog size.
    """
    t = tasks.select(F.col(task_col).alias("task")).where(F.col("task").isNotNull()).distinct()
    kw = dimension(keywords.select("task_category", "keyword"), of=keywords)
    cat_small = catalog.select("model", "pos", "input_credits", "best_for")
    if not catalog.isLocal() and catalog.limit(DIM_MAX_ROWS + 1).count() > DIM_MAX_ROWS:
        raise ValueError(f"price catalog has more than {DIM_MAX_ROWS} models")
    # the catalog as one bounded array in (input price, catalog order): its
    # first k entries are the fallback list (T4), all of it the literal match
    ranked = catalog.agg(F.sort_array(F.collect_list(F.struct("input_credits", "pos", "model")))
                         .alias("_all"))
    ranked = ranked.select(F.transform("_all", lambda c: c["model"]).alias("_all"))
    # (task, category) with unmatched tasks kept (category NULL)
    tc = t.join(kw, F.lower(F.col("task")).contains(F.col("keyword")), "left") \
          .select("task", "task_category")
    if literal:
        # any keyword in the task matches every model
        per_task = tc.groupBy("task").agg(F.max(F.col("task_category").isNotNull()).alias("_hit"))
        matched = F.when(F.col("_hit"), F.col("_all")).otherwise(F.array().cast("array<string>"))
    else:
        uc = cat_small.select("model", F.explode("best_for").alias("use_case"))
        mc = (uc.join(kw, F.lower(F.col("use_case")).contains(F.col("keyword")))
                .select("model", "task_category").distinct())
        tm = tc.join(dimension(mc, of=[catalog, keywords]), "task_category", "left")
        per_task = tm.groupBy("task").agg(F.collect_set("model").alias("_matched"))
        matched = F.col("_matched")
    # ``ranked`` is one row by construction (a global aggregate)
    j = per_task.crossJoin(F.broadcast(ranked))
    fb = F.size(matched) == 0
    picked = j.select("task", fb.alias("fallback"),
                      F.when(fb, F.slice("_all", 1, k)).otherwise(matched).alias("_models"))
    r = (picked.select("task", "fallback", F.explode("_models").alias("model"))
               .join(dimension(cat_small.select("model", "pos", "input_credits"), of=catalog), "model"))
    w = Window.partitionBy("task").orderBy("input_credits", "pos")
    return r.select("task", "model", "input_credits", "fallback",
                    F.row_number().over(w).cast("long").alias("rank"))
