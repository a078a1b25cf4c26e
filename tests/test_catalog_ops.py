"""Catalog dimension operators (P11-P15, P19-P21, T4, T8, A14, A22) against
the totals of the fixed price list."""

from metercast.operators import catalog_ops as CO
from metercast.operators import costing as C
from metercast.sources import catalog as cat


def test_providers_tiers_and_filters(spark, catalog):
    assert [r.provider for r in CO.providers(catalog).collect()] == sorted(
        ["OpenAI", "Anthropic", "Mistral AI", "Meta (Snowflake optimized)", "Meta", "Snowflake", "DeepSeek"])
    assert CO.by_provider(catalog, "OpenAI").count() == 6
    assert CO.by_provider(catalog, "Mistral AI").count() == 4
    assert {t: CO.by_tier(catalog, t).count() for t in ("medium", "small", "large", "premium")} == \
        {"medium": 9, "small": 8, "large": 4, "premium": 1}
    assert CO.available_models(catalog).count() == 11
    allow = spark.createDataFrame([("mistral-7b",), ("not-a-model",)], "model string")
    assert [r.model for r in CO.allowed_models(catalog, allow).collect()] == ["mistral-7b"]
    assert CO.allowed_models(catalog, ["llama3.1-8b", "x"]).count() == 1


def test_named_tier_members(spark, catalog):
    m = CO.tier_members(catalog, cat.load_named_tiers(spark)).collect()
    got = {}
    for r in m:
        got.setdefault(r.tier, set()).add(r.model)
    assert got == {"Budget": {"mistral-7b"},
                   "Balanced": {"llama3.1-8b", "mixtral-8x7b", "snowflake-arctic"},
                   "Premium": {"llama3.1-70b", "mistral-large2", "claude-3-5-sonnet"}}


def test_sorts_and_view(spark, catalog):
    low = [r.model for r in CO.sort_catalog(catalog).collect()]
    assert low[:2] == ["openai-gpt-5-nano", "llama3.1-8b"]      # tie at 0.03: catalog order
    assert [r.model for r in CO.sort_catalog(catalog, "Input Price (High→Low)").limit(1).collect()] == \
        ["claude-4-opus"]
    assert CO.sort_catalog(catalog, "Model Name").first().model == "claude-3-5-sonnet"
    v = {r.model: r for r in CO.catalog_view(catalog, price=3.0, selected=["mistral-7b"]).collect()}
    nano = v["openai-gpt-5-nano"]
    assert nano.tier == "Small" and abs(nano.input_usd_per_1m - 0.09) < 1e-12
    assert nano.best_for == "Simple classification, Basic extraction"
    assert v["mistral-7b"].selected and not nano.selected
    assert v["claude-4-opus"].vision == "vision" and v["mistral-7b"].availability == "available"


def test_price_ratio_and_cheapest(catalog):
    r = C.catalog_price_ratio(catalog).first()
    assert (r.min_cost, r.max_cost, r.price_ratio) == (0.03, 7.5, 250.0)
    assert [x.model for x in CO.cheapest_models(catalog, 5).collect()] == [
        "openai-gpt-5-nano", "llama3.1-8b", "mistral-7b", "mixtral-8x7b", "openai-gpt-5-mini"]
