"""Registered queries costing texts and request logs on the catalog
(C2, C3, C5, C18, C19, C20, E4, E16, T4, P15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog_ops as CO
from ..operators import costing as C
from ..operators import text_stats as TS
from ..sources import catalog as CAT
from . import fixtures_sql as X
from .registry import register, td


# --- C18 token statistics, E16 prompt fill ---------------------------------------------


_STATS = f"""COUNT(*) AS sample_size, AVG(t) AS avg_tokens, MIN(t) AS min_tokens, MAX(t) AS max_tokens,
       round(stddev_samp(t), 6) AS stddev_tokens"""


@register("text_token_stats", f"""
SELECT {_STATS} FROM (SELECT {X.TOK_SQL} AS t FROM documents WHERE text IS NOT NULL) s""")
def q_text_token_stats(spark, sf_dir):
    return TS.token_stats(td(spark, sf_dir).texts(), "text")


@register("sampled_token_stats", f"""
SELECT {_STATS} FROM (SELECT {X.TOK_SQL} AS t FROM documents WHERE text IS NOT NULL
                      ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100) s""")
def q_sampled_token_stats(spark, sf_dir):
    return TS.sampled_token_stats(td(spark, sf_dir).texts(), "text", "doc_id", 100)


PROMPT = "Summarize the following text in one sentence:\n\n{text}"
_PROMPT_SQL = "replace('" + PROMPT.replace("'", "''") + "', '{text}', text)"


@register("prompt_fill", f"""
SELECT doc_id, md5({_PROMPT_SQL}) AS prompt_md5, CAST(length({_PROMPT_SQL}) AS INTEGER) AS prompt_chars,
       CASE WHEN length({_PROMPT_SQL}) > 0 THEN greatest(1, length({_PROMPT_SQL}) // 4) ELSE 0 END AS prompt_tokens,
       {X.IN_TOK_SQL} AS text_tokens
FROM documents WHERE text IS NOT NULL""")
def q_prompt_fill(spark, sf_dir):
    return TS.fill_prompts(td(spark, sf_dir).texts(), "text", PROMPT, "doc_id")


# --- C19 corpus cost, C5 price spread ---------------------------------------------------


def _corpus_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return X.with_(X.CAT, f"""g AS (
  SELECT {k}COUNT(*) AS rows, CAST(SUM({X.IN_TOK_SQL}) AS BIGINT) AS input_tokens,
         CAST(SUM(150) AS BIGINT) AS output_tokens
  FROM documents WHERE text IS NOT NULL {grp})""") + f"""
SELECT {k}model, pos, rows, input_tokens, output_tokens, {X.cost_sql(X.E8_SQL)}, {X.ROUND2_SQL} AS total_cost_usd
FROM g CROSS JOIN cat WHERE rows > 0"""


@register("corpus_cost_by_model", _corpus_sql(""))
def q_corpus_cost_by_model(spark, sf_dir):
    return C.estimate_text_cost(td(spark, sf_dir).texts(), "text", CAT.load_catalog(spark), 150)


@register("corpus_cost_by_lang_model", _corpus_sql("lang"))
def q_corpus_cost_by_lang_model(spark, sf_dir):
    return C.estimate_text_cost(td(spark, sf_dir).texts(), "text", CAT.load_catalog(spark), 150,
                                keys=["lang"])


@register("price_spread_by_lang", "WITH c AS (" + _corpus_sql("lang") + """)
SELECT lang, MIN(total_cost_usd_raw) AS min_cost, MAX(total_cost_usd_raw) AS max_cost,
       COUNT(*) AS n_models,
       CASE WHEN MIN(total_cost_usd_raw) > 0 THEN MAX(total_cost_usd_raw) / MIN(total_cost_usd_raw)
            ELSE 0.0 END AS price_ratio
FROM c GROUP BY lang""")
def q_price_spread_by_lang(spark, sf_dir):
    costs = C.estimate_text_cost(td(spark, sf_dir).texts(), "text", CAT.load_catalog(spark), 150,
                                 keys=["lang"])
    return C.price_spread(costs, ["lang"])


# --- C20 request-log cost, C2, C3, T4, P15 ----------------------------------------------

_CONV_CTE = """conv AS (
  SELECT conv_id, COUNT(*) AS turns,
         CAST(SUM(CASE WHEN role <> 'assistant' THEN greatest(1, length(coalesce(text, '')) // 4) ELSE 0 END) AS BIGINT) AS input_tokens,
         CAST(SUM(CASE WHEN role = 'assistant' THEN coalesce(length(text) // 4, 0) ELSE 0 END) AS BIGINT) AS output_tokens
  FROM conversations GROUP BY conv_id)"""
_CONV = X.with_(X.CAT, _CONV_CTE)
_CONV_COST = X.with_(X.CAT, _CONV_CTE, f"""cc AS (
  SELECT conv_id, turns, model, pos, input_tokens, output_tokens,
         CAST({X.E8_SQL} * 300 AS DOUBLE) / 1e10 AS cost, {X.ROUND2_SQL} AS usd
  FROM conv CROSS JOIN cat)""")


@register("request_cost_by_model", _CONV + f"""
SELECT model, requests, input_tokens, output_tokens, {X.cost_sql(X.E8_SQL)}
FROM (SELECT COUNT(*) AS requests, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens,
             CAST(SUM(output_tokens) AS BIGINT) AS output_tokens FROM conv) g CROSS JOIN cat""")
def q_request_cost_by_model(spark, sf_dir):
    return C.estimate_request_cost(td(spark, sf_dir).conversations(), CAT.load_catalog(spark))


@register("cheapest_model_per_conversation", _CONV_COST + """
SELECT lo.conv_id, lo.input_tokens, lo.output_tokens, lo.model AS cheapest_model, lo.cost AS cheapest_cost_usd,
       hi.model AS dearest_model, hi.cost AS dearest_cost_usd,
       CASE WHEN hi.cost > 0 THEN (hi.cost - lo.cost) / hi.cost * 100.0 ELSE 0.0 END AS savings_pct
FROM (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, pos) = 1) lo
JOIN (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost DESC, pos) = 1) hi
USING (conv_id)""")
def q_cheapest_model_per_conversation(spark, sf_dir):
    return C.cheapest_model_per_request(td(spark, sf_dir).conversations(), CAT.load_catalog(spark))


@register("cheapest_k_models_per_conversation", _CONV_COST + """
SELECT conv_id, rank, model, cost AS total_cost_usd_raw FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, pos) AS rank FROM cc) r
WHERE rank <= 5""")
def q_cheapest_k_models_per_conversation(spark, sf_dir):
    return C.cheapest_k_per_request(td(spark, sf_dir).conversations(), CAT.load_catalog(spark), 5)


@register("compare_models", _CONV + f"""
SELECT conv_id, turns, model, pos, input_tokens, output_tokens, {X.cost9('input_tokens', 'output_tokens')}
FROM conv CROSS JOIN cat""")
def q_compare_models(spark, sf_dir):
    per = C.request_tokens(td(spark, sf_dir).conversations())
    return C.compare_models(per, CAT.load_catalog(spark))


def _calculator_sql(cat_filter: str, n_models: int) -> str:
    return X.with_(
        X.CAT, _CONV_CTE,
        f"allowed AS (SELECT * FROM cat {cat_filter})",
        "w AS (SELECT conv_id, input_tokens * 10000 AS input_tokens, output_tokens * 10000 AS output_tokens FROM conv)",
        f"c AS (SELECT conv_id, model, pos, {X.cost9('input_tokens', 'output_tokens')} FROM w CROSS JOIN allowed)",
        """lo AS (SELECT * FROM c QUALIFY row_number() OVER (
      PARTITION BY conv_id ORDER BY total_cost_usd, total_cost_usd_raw, pos) = 1)""",
        """hi AS (SELECT * FROM c QUALIFY row_number() OVER (
      PARTITION BY conv_id ORDER BY total_cost_usd DESC, total_cost_usd_raw DESC, pos DESC) = 1)""") + f"""
SELECT conv_id AS work_id, CAST({n_models} AS BIGINT) AS n_models, lo.model AS cheapest_model,
       lo.total_cost_usd AS cheapest_cost_usd,
       hi.model AS most_expensive_model, hi.total_cost_usd AS most_expensive_cost_usd,
       hi.total_cost_usd - lo.total_cost_usd AS savings_usd,
       CASE WHEN hi.total_cost_usd > 0 THEN (hi.total_cost_usd - lo.total_cost_usd) / hi.total_cost_usd * 100.0
            ELSE 0.0 END AS savings_pct
FROM lo JOIN hi USING (conv_id)"""


@register("cost_calculator", _calculator_sql("", 22))
def q_cost_calculator(spark, sf_dir):
    return C.cost_calculator(_workloads(spark, sf_dir), CAT.load_catalog(spark))


def _workloads(spark, sf_dir):
    """Each conversation as a workload: its tokens per request, 10,000 requests."""
    per = C.request_tokens(td(spark, sf_dir).conversations())
    return per.select(F.col("conv_id").alias("work_id"),
                      F.col("input_tokens").alias("input_tokens_per_request"),
                      F.col("output_tokens").alias("output_tokens_per_request"),
                      F.lit(10000).cast("long").alias("requests"))


@register("cost_calculator_available", _calculator_sql("WHERE available", 11))
def q_cost_calculator_available(spark, sf_dir):
    """C3 on the models the account can use (P12): the catalog's available ones."""
    return C.cost_calculator(_workloads(spark, sf_dir), CO.available_models(CAT.load_catalog(spark)))


@register("request_cost_by_named_tier", X.with_(
    X.CAT, _CONV_CTE, f"tiers AS (SELECT * FROM {CAT.tiers_values_sql('t')})") + f"""
SELECT tier, model, requests, input_tokens, output_tokens, {X.cost_sql(X.E8_SQL)}
FROM (SELECT COUNT(*) AS requests, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens,
             CAST(SUM(output_tokens) AS BIGINT) AS output_tokens FROM conv) g
CROSS JOIN cat JOIN tiers USING (model)""")
def q_request_cost_by_named_tier(spark, sf_dir):
    return C.named_tier_costs(td(spark, sf_dir).conversations(), CAT.load_catalog(spark),
                              CAT.load_named_tiers(spark))


# --- C19 with E4: corpus cost per test type ---------------------------------------------

_TT = ", ".join("('" + t + "')" for t in C.TEST_TYPES)


@register("corpus_cost_by_test_type", X.with_(X.CAT, f"""g AS (
  SELECT COUNT(*) AS rows, CAST(SUM({X.IN_TOK_SQL}) AS BIGINT) AS input_tokens
  FROM documents WHERE text IS NOT NULL)""", f"""t AS (
  SELECT test_type, rows, input_tokens,
         rows * CASE WHEN contains(test_type, 'Sentiment') OR contains(test_type, 'Classify') THEN 10
                     WHEN contains(test_type, 'Summarize') THEN 100 ELSE 150 END AS output_tokens
  FROM g CROSS JOIN (VALUES {_TT}) v(test_type) WHERE rows > 0)""") + f"""
SELECT test_type, model, pos, rows, input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens,
       {X.cost_sql(X.E8_SQL)}, {X.ROUND2_SQL} AS total_cost_usd
FROM t CROSS JOIN cat""")
def q_corpus_cost_by_test_type(spark, sf_dir):
    return C.estimate_by_test_type(td(spark, sf_dir).texts(), "text", CAT.load_catalog(spark))


# --- C33 embedding cost of the corpus ------------------------------------------------------

@register("corpus_embedding_cost_by_lang", X.with_(
    f"rates AS (SELECT * FROM {CAT.rates_values_sql('embedding', 'r')})", f"""g AS (
  SELECT lang, COUNT(*) AS rows, CAST(SUM({X.TOK_SQL}) AS BIGINT) AS tokens
  FROM documents WHERE text IS NOT NULL GROUP BY lang)""") + """
SELECT lang, name AS embedding_model, rows, tokens, CAST(tokens * rate_centi AS DOUBLE) / 1e8 AS credits
FROM g CROSS JOIN rates""")
def q_corpus_embedding_cost_by_lang(spark, sf_dir):
    return C.embedding_cost(td(spark, sf_dir).texts(), "text", CAT.load_rates(spark), keys=["lang"])


# --- Q3 with count_template: the filled prompts' tokens per test type --------------------

def _prompt_tokens_sql(template) -> str:
    if template is None:
        return X.IN_TOK_SQL
    extra = len(template) - len("{text}")
    m = f"(length(text) + {extra})"
    return f"CASE WHEN {m} > 0 THEN greatest(1, {m} // 4) ELSE 0 END"


_PER_TYPE = "\n  UNION ALL ".join(
    f"SELECT '{t}' AS test_type, COUNT(*) AS rows, "
    f"CAST(SUM({_prompt_tokens_sql(C.TEST_PROMPTS[t])}) AS BIGINT) AS input_tokens FROM d"
    for t in C.TEST_TYPES)


@register("corpus_cost_by_test_prompt", X.with_(
    X.CAT,
    "d AS (SELECT text FROM documents WHERE text IS NOT NULL)",
    f"p AS ({_PER_TYPE})",
    """t AS (
  SELECT test_type, rows, input_tokens,
         rows * CASE WHEN contains(test_type, 'Sentiment') OR contains(test_type, 'Classify') THEN 10
                     WHEN contains(test_type, 'Summarize') THEN 100 ELSE 150 END AS output_tokens
  FROM p WHERE rows > 0)""") + f"""
SELECT test_type, model, pos, rows, input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens,
       {X.cost_sql(X.E8_SQL)}, {X.ROUND2_SQL} AS total_cost_usd
FROM t CROSS JOIN cat""")
def q_corpus_cost_by_test_prompt(spark, sf_dir):
    return C.estimate_by_test_type(td(spark, sf_dir).texts(), "text", CAT.load_catalog(spark),
                                   count_template=True)
