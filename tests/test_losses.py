"""Nothing is lost or cut silently: digits, rows, names, missing sources; plans of the sample and the top-k."""

import os
import subprocess
import sys
from datetime import datetime

import pytest

from metercast.functions import money
from metercast.operators import costing as C
from metercast.operators import reconcile as RC
from metercast.operators import runs as RU
from metercast.operators import scoring as SC
from metercast.operators import text_stats as TS
from metercast.operators.common import DIM_MAX_BYTES, dimension
from metercast.sources import catalog as CAT
from metercast.sources.readers import read_usage_tolerant
from metercast.streaming import budget_monitor as BM

from .conftest import SF_SMALL


def test_rates_and_prices_are_exact_or_refused(spark, catalog):
    with pytest.raises(ValueError):
        CAT._centi("0.125")
    assert CAT._centi("0.120") == 12 and CAT._centi("7") == 700
    assert money.price_centi(3.0) == 300 and str(money.price_centi(2.555)) == "255.5"
    work = spark.createDataFrame([("llama3.1-8b", 1_000_000, 0)], "model string, input_tokens long, output_tokens long")
    # 0.03 credits at $2.555
    assert C.with_cost(work, catalog, price=2.555).first().total_cost_usd_raw == 0.07665


def test_price_lists_hold_the_published_values():
    """Rates checked against literals, not against the module that serves them."""
    rows = {r[1]: (r[3], r[4]) for r in CAT.catalog_rows()}
    assert len(rows) == 22
    assert rows["llama3.1-8b"] == (0.03, 0.03) and rows["claude-4-opus"] == (7.5, 37.5)
    units = {r[1]: (r[2], r[5]) for r in CAT.rate_rows("service")}
    assert units == {"cortex_analyst": (67.0, 1000), "cortex_search_serving": (6.3, 1),
                     "ai_parse_document_layout": (3.33, 1000), "ai_parse_document_ocr": (0.5, 1000), "document_ai": (8.0, 1)}


def test_long_test_names_stay_apart(spark):
    name = "a test with a name of more than twenty characters"
    res = spark.createDataFrame([(name + "1", "m", "F", 0.5, 5 * 10**9, "success"), (name + "2", "m", "F", 0.7, 7 * 10**9, "success")],
                                "test string, model string, function string, cost double, cost_e10 long, status string")
    assert {r.test for r in RU.scale_runs(res, [100]).collect()} == {name + "1", name + "2"}
    assert RU.savings_at_scale_from_results(res, [100]).first().savings == pytest.approx(20.0)


def test_units_keep_their_decimals(spark):
    units = spark.createDataFrame([("document_ai", 0.00000125)], "name string, units double")
    assert C.rate_list_cost(units, CAT.load_rates(spark)).first().credits == pytest.approx(0.00001, abs=1e-12)


def test_only_missing_sources_are_tolerated(spark, tmp_path):
    good = spark.createDataFrame([(datetime(2024, 1, 2), 1.5, None), (datetime(2024, 1, 3), 2.0, "F")],
                                 "start_time timestamp, credits double, function_name string")
    specs = [RC.SourceSpec("a", lambda: good, "credits"),
             RC.SourceSpec("gone", lambda: spark.read.parquet(f"{tmp_path}/nothing"), "credits"),
             RC.SourceSpec("no table", lambda: spark.table("no_such_table"), "credits")]
    got = {r.service: (r.credits, r.status) for r in RC.reconcile_services(specs, "2024-01-04 00:00:00", 30).collect()}
    assert got == {"a": (3.5, "OK"), "gone": (0.0, "No Access"), "no table": (0.0, "No Access")}
    with pytest.raises(Exception, match="misspelt"):
        RC.reconcile_services([RC.SourceSpec("a", lambda: good, "misspelt")], "2024-01-04 00:00:00", 30).collect()
    assert read_usage_tolerant(spark, f"{tmp_path}/nothing", "metering")[1] is False


def test_sample_carries_no_texts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = TS.sampled_token_stats(docs, "text", "doc_id", 50)._jdf.queryExecution().executedPlan().toString()
    above_scan = [line for line in plan.splitlines() if "WindowGroupLimit" in line or "Exchange" in line or "TakeOrdered" in line]
    assert above_scan and not any("text#" in line for line in above_scan)


def test_large_local_frames_are_not_broadcast(spark):
    small = spark.createDataFrame([(1,)], "a long")
    large = spark.createDataFrame([("x" * (DIM_MAX_BYTES // 4),)] * 6, "a string")
    hint = lambda d: "ResolvedHint" in dimension(d)._jdf.queryExecution().analyzed().toString()
    assert hint(small) and not hint(large)


def test_scored_rows_feed_the_comparisons(spark, catalog):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(20)], "doc_id long, text string")
    scored = SC.score_texts(docs, "text", "doc_id", ["llama3.1-8b", "mistral-7b", "unknown"], SC.echo_scorer_factory(), catalog,
                            template="Say: {text}", parallelism=3)
    res = SC.result_rows(scored, "my test", "SENTIMENT - Prompt")
    assert RU.compare_all(res).first().total_runs == 40
    assert {(r.test_type, r.function) for r in RU.results_table(res).collect()} == {("SENTIMENT - Prompt", "SENTIMENT")}
    assert RU.scale_runs(res, [100]).count() == 40 and RU.winners(res).first().runs == 40


def test_a_call_that_raises_is_not_repeated(spark, catalog):
    def factory():
        calls = []

        def score(model, prompts):
            calls.append(len(prompts))
            raise RuntimeError("down " + "x" * 600 + str(len(calls)))
        return score
    docs = spark.createDataFrame([(k, "t") for k in range(6)], "doc_id long, text string").coalesce(1)
    out = SC.score_texts(docs, "text", "doc_id", ["mistral-7b"], factory, catalog, batch_size=3).collect()
    assert sorted(r.response[-1] for r in out) == ["1"] * 3 + ["2"] * 3 and all(len(r.response) == 606 for r in out)


def test_closed_months_leave_the_state(spark, tmp_path):
    """January closes when March begins: its late rows count until then, not after."""
    feed, n = tmp_path / "feed", 0
    feed.mkdir()
    schema = "start_time timestamp, service_type string, credits_used double"
    batches = [[(1, 5)], [(2, 1), (1, 31)], [(3, 1)], [(3, 2)], [(1, 20), (3, 3)], [(5, 1)], [(5, 2)]]
    for n, rows in enumerate(batches):
        part = spark.createDataFrame([(datetime(2024, m, d), "AI_SERVICES", 1.0) for m, d in rows], schema)
        part.coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        source = next((tmp_path / f"b{n}").glob("part-*.parquet"))
        os.utime(source, (1_700_000_000 + n, 1_700_000_000 + n))
        os.link(source, feed / f"f{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(feed))
    limits = spark.createDataFrame([("monthly", 100.0, True)], "period string, `limit` double, enabled boolean")
    seen = []

    def keep(batch, _):
        seen.append({r.window_start.month: r.used for r in batch.collect()})
    q = (BM.budget_windows(stream, limits, periods=("monthly",)).writeStream.outputMode("update").foreachBatch(keep)
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    states = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert [s for s in seen if s][:2] == [{1: 1.0}, {1: 2.0, 2: 1.0}]
    assert all(s.get(1) in (None, 1.0, 2.0) for s in seen), seen     # January's row that came in the midst of March is dropped
    assert {k for s in seen for k in s} == {1, 2, 3, 5}
    assert max(states) <= 3 and states[-1] <= 2


def test_queries_run_from_another_folder(tmp_path):
    """Python workers get the package wherever the driver was started."""
    code = ("import sys; sys.path.insert(0, {root!r})\n"
            "import __spark_entry__ as E\n"
            "from metercast.session import get_session\n"
            "s = get_session('local[2]', shuffle_partitions=2)\n"
            "print('ROWS', E.queries()['score_texts'](s, {sf!r}).count())\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code.format(root=root, sf=SF_SMALL)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=180)
    assert "ROWS 800" in out.stdout, out.stderr[-800:]


def test_distinct_models_of_variants(spark):
    res = spark.createDataFrame([("SENTIMENT", "a", 10, 5 * 10**6, 50, "success"), ("SENTIMENT", "a", 10, 5 * 10**6, 70, "success"),
                                 ("SENTIMENT", "b", 10, 5 * 10**6, 30, "error")],
                                "function string, model string, output_tokens long, cost_e10 long, latency_centi long, status string")
    bi = spark.createDataFrame([("SENTIMENT", "a (via SENTIMENT)", "x" * 40, 10, "success")],
                               "function string, model string, response string, latency_centi long, status string")
    got = {r.variant: r for r in RU.prompt_vs_builtin(res, bi).collect()}
    assert (got["prompt"].runs, got["prompt"].models, got["prompt"].avg_latency) == (2, 1, 0.6)
    assert (got["builtin"].output_tokens, got["builtin"].total_cost, got["builtin"].avg_latency) == (10, 0.0001, 0.1)


def test_sorted_reports_come_in_order(spark):
    """The order itself, not only the values."""
    from metercast.plans import registry

    def rows(name):
        return registry.QUERIES[name](spark, SF_SMALL).collect()
    hours = [r.start_time for r in rows("hourly_function_usage")]
    days = [r.usage_date for r in rows("daily_service_usage")]
    costs = [(r.est_cost, r.model) for r in rows("project_to_table")]
    top = [-r.token_credits for r in rows("top_query_usage")]
    dear = [-r.token_credits for r in rows("top_expensive_queries")]
    assert hours == sorted(hours, reverse=True) and len(set(hours)) > 1
    assert days == sorted(days, reverse=True) and len(set(days)) > 1
    assert costs == sorted(costs) and top == sorted(top) and dear == sorted(dear)
