"""Hand-computed cost values."""

import pytest
from pyspark.sql import functions as F

from metercast.functions import tokens
from metercast.operators import catalog_ops as CO
from metercast.operators import costing as C
from metercast.sources import catalog as cat


def test_catalog_shape(catalog):
    rows = catalog.collect()
    assert len(rows) == 22
    assert sum(r.available for r in rows) == 11
    assert sum(r.supports_vision for r in rows) == 8
    by = {r.model: r for r in rows}
    assert by["llama3.1-70b"].in_centi == 29 and by["claude-4-opus"].out_centi == 3750


def test_with_cost_opus_one_million(spark, catalog):
    df = spark.createDataFrame([("claude-4-opus", 1_000_000, 1_000_000)],
                               "model string, input_tokens long, output_tokens long")
    r = C.with_cost(df, catalog).collect()[0]
    assert r.total_credits == 45.0
    assert r.input_credits == 7.5 and r.output_credits == 37.5
    assert r.total_cost_usd == 135.0


def test_with_cost_unknown_model_strict_raises(spark, catalog):
    df = spark.createDataFrame([("no-such-model", 10, 10)],
                               "model string, input_tokens long, output_tokens long")
    with pytest.raises(Exception, match="Unknown model"):
        C.with_cost(df, catalog, strict=True).collect()
    assert C.with_cost(df, catalog, strict=False).count() == 0


def test_compare_models_cardinality(spark, catalog):
    work = spark.createDataFrame([(1, 100, 10), (2, 5, 0)], "id int, input_tokens long, output_tokens long")
    assert C.compare_models(work, catalog).count() == 2 * 22


def test_cost_calculator_defaults(spark, catalog):
    work = spark.createDataFrame([(1, 1000, 100, 10000)],
                                 "work_id int, input_tokens_per_request long, "
                                 "output_tokens_per_request long, requests long")
    r = C.cost_calculator(work, catalog).collect()[0]
    assert r.cheapest_model == "llama3.1-8b" and r.cheapest_cost_usd == 0.99
    assert r.most_expensive_model == "claude-4-opus" and r.most_expensive_cost_usd == 337.5
    assert round(r.savings_pct, 1) == 99.7
    assert r.savings_usd >= 0
    allowed = C.cost_calculator(work, catalog, allowed=["openai-gpt-5-nano", "llama3.1-8b"]).collect()[0]
    assert allowed.n_models == 2 and allowed.most_expensive_cost_usd == 1.56


def test_price_ratio_whole_catalog(catalog):
    r = C.catalog_price_ratio(catalog).collect()[0]
    assert r.price_ratio == pytest.approx(250.0)


def test_cheapest_five(catalog):
    got = [r.model for r in CO.cheapest_models(catalog, 5).collect()]
    assert got == ["openai-gpt-5-nano", "llama3.1-8b", "mistral-7b", "mixtral-8x7b", "openai-gpt-5-mini"]


def test_token_estimates(spark):
    df = spark.createDataFrame([("",), ("abc",), ("abcdefgh",), (None,), ("é" * 9,)], "t string")
    rows = df.select(tokens.est_tokens("t").alias("e1"), tokens.est_input_tokens("t").alias("e2"),
                     tokens.est_output_tokens("t").alias("e3")).collect()
    assert [r.e1 for r in rows][:3] == [1, 1, 2]
    assert [r.e2 for r in rows] == [0, 1, 2, 0, 2]
    assert [r.e3 for r in rows] == [0, 0, 2, 0, 2]


def test_expected_output_tokens_case_sensitive(spark):
    df = spark.createDataFrame([("Sentiment Analysis",), ("Classify Text",), ("Summarize",),
                                ("SENTIMENT - Built-in",), ("Custom",)], "t string")
    got = [r.o for r in df.select(tokens.expected_output_tokens("t").alias("o")).collect()]
    assert got == [10, 10, 100, 150, 150]


def test_prompt_fill_is_literal(spark):
    df = spark.createDataFrame([("a.*b$1",)], "t string")
    r = df.select(tokens.fill_prompt("X {text} Y {text}", F.col("t")).alias("p")).collect()[0]
    assert r.p == "X a.*b$1 Y a.*b$1"


def test_models_for_task_modes(spark, catalog):
    tasks = spark.createDataFrame([("SENTIMENT",), ("COMPLETE",), ("CLASSIFY_TEXT",)], "task string")
    kw = cat.load_task_keywords(spark)
    intent = CO.models_for_task(tasks, catalog, kw).collect()
    by = {}
    for r in intent:
        by.setdefault(r.task, []).append((r["rank"], r.model, r.fallback))
    assert [m for _, m, _ in sorted(by["SENTIMENT"])] == ["openai-gpt-5-mini"]
    assert [m for _, m, _ in sorted(by["CLASSIFY_TEXT"])] == ["openai-gpt-5-nano", "openai-gpt-5-mini"]
    assert all(fb for _, _, fb in by["COMPLETE"]) and len(by["COMPLETE"]) == 5
    literal = CO.models_for_task(tasks, catalog, kw, literal=True)
    counts = {r.task: r["count"] for r in literal.groupBy("task").count().collect()}
    assert counts == {"SENTIMENT": 22, "CLASSIFY_TEXT": 22, "COMPLETE": 5}


def test_cost_linear_in_tokens(spark, catalog):
    df = spark.createDataFrame([("mistral-large2", 1000, 500), ("mistral-large2", 2000, 1000)],
                               "model string, input_tokens long, output_tokens long")
    a, b = [r.total_credits_raw for r in C.with_cost(df, catalog).orderBy("input_tokens").collect()]
    assert b == pytest.approx(2 * a)


def test_estimate_by_test_type_output_tokens(spark, catalog):
    from metercast.operators import costing as C
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "abcd"), (3, None)], "doc_id long, text string")
    out = C.estimate_by_test_type(docs, "text", catalog).where("model = 'llama3.1-8b'").collect()
    per = {r.test_type: (r.rows, r.input_tokens, r.output_tokens) for r in out}
    # labels match case-sensitively: only the COMPLETE variants name Summarize / Classify
    assert per == {
        "COMPLETE - Custom Prompt": (2, 3, 300), "COMPLETE - Summarize": (2, 3, 200),
        "COMPLETE - Classify": (2, 3, 20), "COMPLETE - Extract": (2, 3, 300),
        "SENTIMENT - Built-in": (2, 3, 300), "SUMMARIZE - Built-in": (2, 3, 300),
        "Compare: COMPLETE vs SENTIMENT": (2, 3, 300), "Compare: COMPLETE vs SUMMARIZE": (2, 3, 300)}


def test_rate_list_cost_units(spark):
    from metercast.operators import costing as C
    from metercast.sources.catalog import load_rates
    units = spark.createDataFrame(
        [("cortex_analyst", 2500.0), ("ai_parse_document_layout", 1000.0), ("cortex_search_serving", 2.5),
         ("document_ai", 1.25), ("SENTIMENT", 2_000_000.0), ("no_such_rate", 5.0)],
        "name string, units double")
    got = {r.name: r.credits for r in C.rate_list_cost(units, load_rates(spark)).collect()}
    assert got == {"cortex_analyst": 167.5, "ai_parse_document_layout": 3.33,
                   "cortex_search_serving": 15.75, "document_ai": 10.0, "SENTIMENT": 0.16,
                   "no_such_rate": None}


def test_embedding_cost_per_model(spark):
    from metercast.operators import costing as C
    from metercast.sources.catalog import load_rates
    docs = spark.createDataFrame([(1, "x" * 4_000_000), (2, "")], "doc_id long, text string")
    got = {r.embedding_model: (r.rows, r.tokens, r.credits)
           for r in C.embedding_cost(docs, "text", load_rates(spark)).collect()}
    # 1,000,000 + 1 (empty text counts 1) tokens
    assert got["voyage-multilingual-2"] == (2, 1_000_001, pytest.approx(0.1000001))
    assert len(got) == 4


def test_test_prompts_cover_every_test_type():
    from metercast.operators import costing as C
    assert list(C.TEST_PROMPTS) == C.TEST_TYPES
    assert all(p is None or "{text}" in p for p in C.TEST_PROMPTS.values())
    assert "[Positive, Negative, Neutral, Mixed]" in C.TEST_PROMPTS["COMPLETE - Classify"]


def test_estimate_by_test_type_counts_filled_prompts(spark, catalog):
    from metercast.operators import costing as C
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "")], "doc_id long, text string")
    got = {r.test_type: r.input_tokens for r in C.estimate_by_test_type(
        docs, "text", catalog, count_template=True).where("model = 'mistral-7b'").collect()}
    t = C.TEST_PROMPTS["COMPLETE - Extract"]
    extra = len(t) - len("{text}")
    assert got["COMPLETE - Extract"] == max(1, (extra + 8) // 4) + max(1, extra // 4)
    assert got["SENTIMENT - Built-in"] == 2          # built-in: the text alone, '' gives 0


def test_template_tokens_without_building_prompts(spark, catalog):
    from metercast.operators import costing as C
    docs = spark.createDataFrame([(1, "x" * 37), (2, ""), (3, "ü" * 5)], "doc_id long, text string")
    tpl = "Summarize: {text}"
    fast = C.estimate_text_cost(docs, "text", catalog, 10, template=tpl, count_template=True).first()
    slow = C.estimate_text_cost(docs, "text", catalog, 10, template=tpl + " {text}", count_template=True)
    want = sum(max(1, (len(tpl) - 6 + n) // 4) for n in (37, 0, 5))
    assert fast.input_tokens == want
    assert slow.first().input_tokens == sum(max(1, (len(tpl) - 6 + 1 + 2 * n) // 4) for n in (37, 0, 5))


def test_request_costs_one_row_per_request_and_model(spark, catalog):
    from metercast.operators import costing as C
    conv = spark.createDataFrame([(1, 1, "user", "x" * 400), (1, 2, "assistant", "y" * 40),
                                  (2, 1, "system", "z" * 8)], "conv_id long, turn long, role string, text string")
    rows = C.request_costs(conv, catalog).collect()
    assert len(rows) == 2 * 22
    r = {(x.conv_id, x.model): x for x in rows}[(1, "llama3.1-8b")]
    assert (r.input_tokens, r.output_tokens) == (100, 10)
    assert r.total_credits_raw == pytest.approx(110 * 0.03 / 1e6)
