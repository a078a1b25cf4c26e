"""Registered queries over logged model runs and test results
(C1, C21-C31, E7, F1, S17)."""

from __future__ import annotations

from ..operators import costing as C
from ..operators import runs as RU
from ..operators import scoring as SC
from ..operators import scoring_ledger as LEDGER
from ..operators import token_counts as TC
from ..session import checkpoint_base
from ..sources import catalog as CAT
from ..sources import sinks as SK
from ..sources.result_cache import snapshot
from ..sources.testdata import MOD8_MODELS
from . import fixtures_sql as X
from .registry import ORACLE, register, td


# --- C21-C31 logged runs, F1 batch scoring ------------------------------------------------


RUN_MODELS = [m for _k, m in MOD8_MODELS if m]
_RUN_CTES = [X.CAT, X.RESULTS, X.RUNS]
_RUNS = X.with_(*_RUN_CTES)
_PTS = ", ".join(f"(CAST({p} AS BIGINT))" for p in RU.SCALE_POINTS)
_PROJ = X.with_(*_RUN_CTES, f"""proj AS (
  SELECT model, p.rows,
         CAST(floor(CAST(input_tokens + output_tokens AS DOUBLE) / r.rows * p.rows) AS BIGINT) AS est_tokens,
         total_cost / r.rows * p.rows AS est_cost,
         time_seconds / r.rows * p.rows / 60.0 AS est_time_min
  FROM runs r CROSS JOIN (VALUES {_PTS}) p(rows) WHERE r.rows > 0)""")


def _runs(spark, sf_dir):
    return td(spark, sf_dir).runs()


@register("run_comparison", _RUNS + """
SELECT model, rows, input_tokens, output_tokens, total_credits AS credits, total_cost AS cost, time_seconds,
       CASE WHEN time_seconds > 0 THEN CAST(input_tokens + output_tokens AS DOUBLE) / time_seconds
            ELSE 0.0 END AS tokens_per_sec
FROM runs""")
def q_run_comparison(spark, sf_dir):
    return RU.compare_runs(_runs(spark, sf_dir))


@register("run_totals", _RUNS + """
SELECT COUNT(*) AS models_tested, CAST(SUM(rows) AS BIGINT) AS total_rows,
       CAST(SUM(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
       CAST(SUM(e10) AS DOUBLE) / 1e10 AS total_cost,
       (SELECT model FROM runs ORDER BY total_cost, model LIMIT 1) AS cheapest_model,
       (SELECT total_cost FROM runs ORDER BY total_cost, model LIMIT 1) AS cheapest_cost,
       (SELECT model FROM runs ORDER BY time_seconds, model LIMIT 1) AS fastest_model,
       (SELECT time_seconds FROM runs ORDER BY time_seconds, model LIMIT 1) AS fastest_seconds
FROM runs""")
def q_run_totals(spark, sf_dir):
    return RU.run_totals(_runs(spark, sf_dir))


@register("project_scale", _PROJ + "SELECT * FROM proj")
def q_project_scale(spark, sf_dir):
    return RU.project_scale(_runs(spark, sf_dir))


@register("projection_pivot", _PROJ + "SELECT rows, " + ", ".join(
    f"MAX(CASE WHEN model = '{m}' THEN est_cost END) AS \"{m}\"" for m in RUN_MODELS)
    + " FROM proj GROUP BY rows")
def q_projection_pivot(spark, sf_dir):
    return RU.projection_pivot(RU.project_scale(_runs(spark, sf_dir)), RUN_MODELS)


@register("best_per_scale", _PROJ + """
SELECT rows, n_models, model AS cheapest_model, est_cost AS cheapest_cost, dearest_cost,
       dearest_cost - est_cost AS savings
FROM (SELECT *, COUNT(*) OVER (PARTITION BY rows) AS n_models,
             MAX(est_cost) OVER (PARTITION BY rows) AS dearest_cost,
             row_number() OVER (PARTITION BY rows ORDER BY est_cost, model) AS rn
      FROM proj WHERE rows IN (1000, 10000, 100000)) x
WHERE rn = 1""")
def q_best_per_scale(spark, sf_dir):
    return RU.best_per_scale(RU.project_scale(_runs(spark, sf_dir)))


@register("project_to_table", X.with_(*_RUN_CTES, """t AS (
  SELECT model, n.table_rows, total_cost / rows * n.table_rows AS est_cost,
         time_seconds / rows * n.table_rows / 60.0 AS est_time_min
  FROM runs CROSS JOIN (SELECT COUNT(*) AS table_rows FROM documents WHERE text IS NOT NULL) n
  WHERE rows > 0)""") + """
SELECT model, table_rows, est_cost, est_time_min, mx - est_cost AS savings_vs_dearest,
       CASE WHEN mx > 0 THEN (mx - est_cost) / mx * 100.0 ELSE 0.0 END AS savings_pct
FROM t CROSS JOIN (SELECT MAX(est_cost) AS mx FROM t) m""")
def q_project_to_table(spark, sf_dir):
    t = td(spark, sf_dir)
    return RU.project_to_table(t.runs(), t.texts(), "text")


_BATCHES = ", ".join(f"(CAST({b} AS BIGINT))" for b in RU.DEFAULT_BATCHES)
_SCALED_CTE = f"""scaled AS (
  SELECT test, model, function, b.rows, cost * b.rows AS total_cost,
         cost AS cost_per_row, e10 * b.rows AS e10
  FROM results CROSS JOIN (VALUES {_BATCHES}) b(rows) WHERE status = 'success')"""
_SCALED = X.with_(X.CAT, X.RESULTS, _SCALED_CTE)


def _scaled(spark, sf_dir):
    return RU.scale_runs(td(spark, sf_dir).results())


@register("scale_runs", _SCALED + """
SELECT test, model, function, rows, total_cost, cost_per_row FROM scaled""")
def q_scale_runs(spark, sf_dir):
    return _scaled(spark, sf_dir).drop("total_cost_e10")


@register("scale_matrix", _SCALED + "SELECT model, " + ", ".join(
    f"MAX(CASE WHEN rows = {b} THEN mean_cost END) AS \"{b}\"" for b in RU.DEFAULT_BATCHES)
    + """ FROM (SELECT model, rows, CAST(SUM(e10) AS DOUBLE) / 1e10 / COUNT(*) AS mean_cost
          FROM scaled GROUP BY model, rows) g GROUP BY model""")
def q_scale_matrix(spark, sf_dir):
    return RU.scale_matrix_from_results(td(spark, sf_dir).results())


@register("savings_at_scale", X.with_(
    X.CAT, X.RESULTS, _SCALED_CTE,
    """sel AS (SELECT * FROM scaled WHERE rows = (
    SELECT COALESCE(MAX(CASE WHEN rows = 100000 THEN rows END), MAX(rows)) FROM scaled))""",
    "lo AS (SELECT * FROM sel ORDER BY e10, model, function, test LIMIT 1)",
    "hi AS (SELECT * FROM sel ORDER BY e10 DESC, model DESC, function DESC, test DESC LIMIT 1)") + """
SELECT lo.rows, lo.model AS cheapest_model, CAST(lo.e10 AS DOUBLE) / 1e10 AS cheapest_cost,
       hi.model AS dearest_model, CAST(hi.e10 AS DOUBLE) / 1e10 AS dearest_cost,
       CAST(hi.e10 - lo.e10 AS DOUBLE) / 1e10 AS savings
FROM lo CROSS JOIN hi""")
def q_savings_at_scale(spark, sf_dir):
    return RU.savings_at_scale_from_results(td(spark, sf_dir).results())


_RES_CTES = [X.CAT, X.RESULTS]
_RES = X.with_(*_RES_CTES)
_OK = "s AS (SELECT * FROM results WHERE status = 'success')"
_FIRST_CHEAP = "c AS (SELECT * FROM s ORDER BY cost, model, function, test LIMIT 1)"
_FIRST_FAST = "l AS (SELECT * FROM s ORDER BY latency, model, function, test LIMIT 1)"


@register("compare_all", _RES + """
SELECT COUNT(DISTINCT test) AS total_tests,
       COUNT(*) FILTER (WHERE status = 'success') AS total_runs,
       COUNT(DISTINCT model) FILTER (WHERE status = 'success') AS models_tested,
       COUNT(DISTINCT function) FILTER (WHERE status = 'success') AS functions_used
FROM results""")
def q_compare_all(spark, sf_dir):
    return RU.compare_all(td(spark, sf_dir).results())


@register("all_results", _RES + """
SELECT test, test_type, model, function, latency, cost, output_tokens FROM results WHERE status = 'success'""")
def q_all_results(spark, sf_dir):
    return RU.results_table(td(spark, sf_dir).results())


@register("winners", X.with_(*_RES_CTES, _OK, _FIRST_CHEAP, _FIRST_FAST) + """
SELECT c.model AS cheapest_model, c.function AS cheapest_function, c.cost AS cheapest_cost,
       l.model AS fastest_model, l.function AS fastest_function, l.latency AS fastest_latency,
       (SELECT CAST(SUM(latency_centi) AS DOUBLE) / 100.0 / COUNT(*) FROM s) AS avg_latency,
       (SELECT COUNT(*) FROM s) AS runs
FROM c CROSS JOIN l""")
def q_winners(spark, sf_dir):
    return RU.winners(td(spark, sf_dir).results())


@register("prompt_vs_builtin", X.with_(
    *_RES_CTES,
    "s AS (SELECT * FROM results WHERE status = 'success' AND function IN ('SENTIMENT', 'SUMMARIZE'))",
    f"""u AS (SELECT function, 'prompt' AS variant, model, output_tokens, e10, latency_centi FROM s
      UNION ALL
      SELECT function, 'builtin', model || ' (via ' || function || ')',
             greatest(1, length(response) // 4), 1000000, latency_centi FROM {X.BUILTIN_RESULTS}
      WHERE function IN ('SENTIMENT', 'SUMMARIZE'))""") + """
SELECT function, variant, COUNT(*) AS runs, COUNT(DISTINCT model) AS models,
       CAST(SUM(output_tokens) AS BIGINT) AS output_tokens, CAST(SUM(e10) AS DOUBLE) / 1e10 AS total_cost,
       CAST(SUM(latency_centi) AS DOUBLE) / 100.0 / COUNT(*) AS avg_latency
FROM u GROUP BY function, variant""")
def q_prompt_vs_builtin(spark, sf_dir):
    t = td(spark, sf_dir)
    return RU.prompt_vs_builtin(t.results(), t.builtin_results())


@register("result_cost_skip_unknown", X.with_(X.CAT) + f"""
SELECT test, model, input_tokens, output_tokens, {X.cost9('input_tokens', 'output_tokens')}
FROM (SELECT l_returnflag || l_linestatus AS test, {X._case('l_partkey % 8', MOD8_MODELS)} AS model,
             CAST(round(l_quantity * 100) AS BIGINT) AS input_tokens, CAST(l_linenumber AS BIGINT) * 50 AS output_tokens
      FROM lineitem) b JOIN cat USING (model)""")
def q_result_cost_skip_unknown(spark, sf_dir):
    """C1 over rows of which an eighth name no model of the catalog: these are skipped."""
    return C.with_cost(td(spark, sf_dir).calls(), CAT.load_catalog(spark), strict=False)


SCORE_MODELS = ["llama3.1-8b", "mistral-large2", "claude-3-5-sonnet", "my-fine-tuned-model"]
SCORE_TEMPLATE = "Summarize the following text in one sentence:\n\n{text}"


_SCORE_MODELS = ", ".join(f"('{m}')" for m in SCORE_MODELS)
_SCORED = X.with_(X.CAT, f"""p AS (
  SELECT doc_id, text, replace({X.text_literal(SCORE_TEMPLATE)}, '{{text}}', text) AS prompt
  FROM documents WHERE text IS NOT NULL)""", f"""s AS (
  SELECT doc_id, v.model, text, prompt, coalesce(in_centi, 0) AS in_centi, coalesce(out_centi, 0) AS out_centi,
         CASE WHEN cat.model IS NULL OR length(prompt) % 97 = 0 THEN 'error' ELSE 'success' END AS status,
         CASE WHEN cat.model IS NULL THEN 'Unknown model: ' || v.model
              WHEN length(prompt) % 97 = 0 THEN 'model ' || v.model || ' failed'
              ELSE '[' || v.model || '] ' || length(prompt) || ' characters, md5 ' || md5(prompt) END AS response
  FROM p CROSS JOIN (VALUES {_SCORE_MODELS}) v(model) LEFT JOIN cat ON cat.model = v.model)""", f"""t AS (
  SELECT doc_id, model, response, status, in_centi, out_centi,
         CASE WHEN status = 'success' THEN {X.IN_TOK_SQL} ELSE 0 END AS input_tokens,
         CASE WHEN status = 'success' THEN length(response) // 4 ELSE 0 END AS output_tokens FROM s)""")


@register("score_texts", _SCORED + f"""
SELECT doc_id, model, response, status, CAST(input_tokens AS BIGINT) AS input_tokens,
       CAST(output_tokens AS BIGINT) AS output_tokens, {X.cost9('input_tokens', 'output_tokens')} FROM t""")
def q_score_texts(spark, sf_dir):
    """F1 with the deterministic stand-in scorer, without the measured latency."""
    return _scored_texts(spark, sf_dir).drop("latency_s")


@register("scored_results", _SCORED + """
SELECT 'documents' AS test, 'SUMMARIZE - One sentence' AS test_type, model, 'SUMMARIZE' AS function,
       CAST((input_tokens * in_centi + output_tokens * out_centi) * 300 AS DOUBLE) / 1e10 AS cost,
       CAST(output_tokens AS BIGINT) AS output_tokens
FROM t WHERE status = 'success'""")
def q_scored_results(spark, sf_dir):
    """F1 rows as test results in the comparison table."""
    rows = SC.result_rows(_scored_texts(spark, sf_dir), "documents", "SUMMARIZE - One sentence")
    return RU.results_table(rows).drop("latency")


@register("score_texts_resumed", ORACLE["score_texts"])
def q_score_texts_resumed(spark, sf_dir):
    """F1 through a ledger kept beside the checkpoints: a run for two of the models, then one for all four, which calls
    the rest only. Calls that an earlier run of this query has made on the same files are not made again."""
    docs, catalog = td(spark, sf_dir).texts(), CAT.load_catalog(spark)
    ledger = LEDGER.ScoringLedger(spark, f"{checkpoint_base(spark)}/scores-{snapshot(docs)[:32]}")
    for models in (SCORE_MODELS[:2], SCORE_MODELS):
        out = LEDGER.score_texts_resumable(docs, "text", "doc_id", models, SC.echo_scorer_factory(fail_every=97), catalog,
                                           ledger, template=SCORE_TEMPLATE, retry_errors=False)
    return out.drop("latency_s")


@register("exact_token_counts")
def q_exact_token_counts(spark, sf_dir):
    """tokens of every document by a public byte-level vocabulary, each distinct text encoded once."""
    return TC.exact_token_counts(td(spark, sf_dir).texts(), "text", "doc_id", TC.vocabulary_tokenizer_factory())


@register("exact_token_stats")
def q_exact_token_stats(spark, sf_dir):
    """C18 with exact counts: the token statistics of each language's documents."""
    return TC.exact_token_stats(td(spark, sf_dir).raw("documents"), "text", "lang", TC.vocabulary_tokenizer_factory())


def _scored_texts(spark, sf_dir):
    return SC.score_texts(td(spark, sf_dir).texts(), "text", "doc_id", SCORE_MODELS,
                          SC.echo_scorer_factory(fail_every=97), CAT.load_catalog(spark),
                          template=SCORE_TEMPLATE)


# --- E7 built-in function runs, compared with the model runs (C21) ---------------------

_BUILTIN_FNS = ", ".join(f"('{f}')" for f in RU.REALTIME_BUILTINS)
_BUILTIN = f"""builtin AS (
  SELECT f.model, g.rows, g.input_tokens, CAST(0 AS BIGINT) AS output_tokens,
         CAST(g.input_tokens * 100 AS DOUBLE) / 1e8 AS total_credits,
         CAST(g.input_tokens * 100 * 300 AS DOUBLE) / 1e10 AS total_cost,
         CAST(0.0 AS DOUBLE) AS time_seconds, CAST(NULL AS VARCHAR) AS sample_output
  FROM (SELECT COUNT(*) AS rows, CAST(COALESCE(SUM(coalesce(length(text) // 4, 0)), 0) AS BIGINT) AS input_tokens
        FROM documents WHERE text IS NOT NULL) g
  CROSS JOIN (VALUES {_BUILTIN_FNS}) f(model) WHERE g.rows > 0)"""


@register("builtin_run_cost", X.with_(_BUILTIN) + "SELECT * FROM builtin")
def q_builtin_run_cost(spark, sf_dir):
    return RU.builtin_runs(td(spark, sf_dir).texts(), "text").drop("cost_e10")


@register("run_comparison_with_builtin", X.with_(*_RUN_CTES, _BUILTIN) + """
SELECT model, rows, input_tokens, output_tokens, total_credits AS credits, total_cost AS cost, time_seconds,
       CASE WHEN time_seconds > 0 THEN CAST(input_tokens + output_tokens AS DOUBLE) / time_seconds
            ELSE 0.0 END AS tokens_per_sec
FROM (SELECT model, rows, input_tokens, output_tokens, total_credits, total_cost, time_seconds FROM runs
      UNION ALL
      SELECT model, rows, input_tokens, output_tokens, total_credits, total_cost, time_seconds FROM builtin) u""")
def q_run_comparison_with_builtin(spark, sf_dir):
    t = td(spark, sf_dir)
    both = t.runs().unionByName(RU.builtin_runs(t.texts(), "text"))
    return RU.compare_runs(both)


# --- S17 export summary (flattened) --------------------------------------------------


@register("export_summary", X.with_(*_RES_CTES, _OK, _FIRST_CHEAP, _FIRST_FAST) + """
SELECT (SELECT COUNT(DISTINCT test) FROM results) AS tests, (SELECT COUNT(*) FROM s) AS results,
       c.model AS cheapest_model, c.cost AS cheapest_cost,
       l.model AS fastest_model, l.latency AS fastest_latency
FROM c CROSS JOIN l""")
def q_export_summary(spark, sf_dir):
    s = SK.results_summary(td(spark, sf_dir).results())
    return s.select("tests", "results", s.cheapest.model.alias("cheapest_model"),
                    s.cheapest.cost.alias("cheapest_cost"), s.fastest.model.alias("fastest_model"),
                    s.fastest.latency.alias("fastest_latency"))


# --- C1 cost record per logged result row ----------------------------------------------

@register("result_cost_records", _RES + f"""
SELECT test, function, model, input_tokens, output_tokens, {X.cost9('input_tokens', 'output_tokens')}
FROM results JOIN cat USING (model)""")
def q_result_cost_records(spark, sf_dir):
    r = td(spark, sf_dir).results().select("test", "function", "model", "input_tokens", "output_tokens")
    return C.with_cost(r, CAT.load_catalog(spark), strict=True)


# --- U4 nested sessions flattened ----------------------------------------------------------

@register("session_results", _RES + """
SELECT 'session ' || CAST(session_id AS VARCHAR) AS test,
       min(function) OVER (PARTITION BY session_id) AS test_type,
       model, function, response, output_tokens, latency, cost, status
FROM results""")
def q_session_results(spark, sf_dir):
    return RU.flatten_sessions(td(spark, sf_dir).sessions())
