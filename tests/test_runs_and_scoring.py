"""Run analytics (C21-C31), the batch scorer (F1, F2) and the driver
contract (entry, queries, oracle_sql)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from metercast.operators import runs as RU
from metercast.operators import scoring as SC
from metercast.sources.testdata import TestData

from .conftest import SF_SMALL


def _runs(spark):
    return spark.createDataFrame(
        [("a", 10, 100, 50, 0.1, 2.0, 5.0), ("b", 10, 100, 50, 0.1, 1.0, 0.0), ("c", 0, 0, 0, 0.0, 0.0, 0.0)],
        "model string, rows long, input_tokens long, output_tokens long, total_credits double, "
        "total_cost double, time_seconds double")


def test_compare_runs_throughput_guard(spark):
    rows = {r.model: r for r in RU.compare_runs(_runs(spark)).collect()}
    assert rows["a"].tokens_per_sec == 30.0 and rows["b"].tokens_per_sec == 0.0


def test_project_scale_skips_empty_runs(spark):
    p = RU.project_scale(_runs(spark))
    assert p.count() == 2 * len(RU.SCALE_POINTS)
    r = p.where((F.col("model") == "a") & (F.col("rows") == 1000)).collect()[0]
    assert r.est_tokens == 15000 and r.est_cost == pytest.approx(200.0)
    assert r.est_time_min == pytest.approx(500.0 / 60.0)


def test_best_per_scale_and_pivot(spark):
    p = RU.project_scale(_runs(spark))
    best = {r.rows: r for r in RU.best_per_scale(p).collect()}
    assert best[1000].cheapest_model == "b" and best[1000].savings == pytest.approx(100.0)
    piv = RU.projection_pivot(p, ["a", "b", "zz"]).orderBy("rows").collect()
    assert piv[0]["a"] == pytest.approx(200.0) and piv[0]["zz"] is None


def test_projection_pivot_rejects_duplicates(spark):
    p = RU.project_scale(_runs(spark))
    with pytest.raises(Exception, match="duplicate"):
        RU.projection_pivot(p.unionByName(p), ["a"]).collect()


def test_scale_round_per_call(spark):
    res = spark.createDataFrame([("t", "m", "COMPLETE", 0.004, "success", 40000000),
                                 ("t", "m", "COMPLETE", 9.0, "error", 0)],
                                "test string, model string, function string, cost double, status string, "
                                "cost_e10 long")
    raw = RU.scale_runs(res, [100000]).collect()
    rounded = RU.scale_runs(res, [100000], round_per_call=True).collect()
    assert len(raw) == 1 and raw[0].total_cost == pytest.approx(400.0)
    assert rounded[0].total_cost == 0.0
    with pytest.raises(ValueError):
        RU.scale_runs(res, [123])


def test_savings_at_scale_falls_back_to_max(spark):
    td = TestData(spark, SF_SMALL)
    scaled = RU.scale_runs(td.results(), [100, 1000])
    r = RU.savings_at_scale(scaled).collect()[0]
    assert r.rows == 1000 and r.savings >= 0


def test_winners_ties_first_in_order(spark):
    res = spark.createDataFrame([("t2", "b", "X", 0.5, 0.1, "success", "r"), ("t1", "a", "Y", 0.5, 0.1, "success", "r"),
                                 ("t0", "0", "Z", 0.0, 0.0, "error", "boom")],
                                "test string, model string, function string, cost double, latency double, "
                                "status string, response string")
    w = RU.winners(res).collect()[0]
    assert (w.cheapest_model, w.fastest_model, w.runs) == ("a", "a", 2)


def test_score_texts_isolates_failures(spark, catalog):
    docs = spark.createDataFrame([(1, "Hello world. Bye."), (2, "x" * 7), (3, None)], "doc_id long, text string")
    out = SC.score_texts(docs, "text", "doc_id", ["llama3.1-8b", "not-in-catalog"],
                         SC.echo_scorer_factory(fail_every=7), catalog).collect()
    unknown = [r for r in out if r.model == "not-in-catalog"]
    assert len(unknown) == 2 and all(r.status == "error" and r.total_cost_usd_raw == 0.0 and r.output_tokens == 0
                                     and r.response == "Unknown model: not-in-catalog" for r in unknown)
    by = {r.doc_id: r for r in out if r.model == "llama3.1-8b"}
    assert by[1].status == "success" and by[1].response.startswith("[llama3.1-8b] 17 characters")
    assert by[2].response == "model llama3.1-8b failed" and by[2].status == "error" and by[2].total_cost_usd_raw == 0.0 and by[2].latency_s == 0.0
    assert 3 not in by


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert "model_analysis" in sql and "score_texts" in sql


def test_summarize_runs_prices_token_sums(spark, catalog):
    res = spark.createDataFrame(
        [("llama3.1-8b", 1000, 100, 0.5, "b", "success"),
         ("llama3.1-8b", 2000, 0, 0.25, "a", "success"),
         ("llama3.1-8b", 9999, 9999, 9.0, "z", "error"),
         ("not-in-catalog", 10, 10, 1.0, "x", "success")],
        "model string, input_tokens long, output_tokens long, latency double, response string, status string")
    with pytest.raises(Exception, match="Unknown model: not-in-catalog"):
        RU.summarize_runs(res, catalog).collect()
    out = {r.model: r for r in RU.summarize_runs(res, catalog, price=3.0, strict=False).collect()}
    assert set(out) == {"llama3.1-8b", "not-in-catalog"} and out["not-in-catalog"].total_cost is None
    r = out["llama3.1-8b"]
    # 3000 in + 100 out at 0.03 credits / 1M each = 9.3e-5 credits, x $3
    assert (r.rows, r.input_tokens, r.output_tokens) == (2, 3000, 100)
    assert r.total_credits == pytest.approx(9.3e-5, abs=1e-15)
    assert r.total_cost == pytest.approx(2.79e-4, abs=1e-15)
    assert r.time_seconds == pytest.approx(0.75)
    assert r.sample_output == "a"


def test_builtin_runs_flat_rate(spark):
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "abc"), (3, ""), (4, None)],
                                 "doc_id long, text string")
    out = {r.model: r for r in RU.builtin_runs(docs, "text", ["SENTIMENT", "SUMMARIZE"]).collect()}
    assert set(out) == {"SENTIMENT", "SUMMARIZE"}
    r = out["SENTIMENT"]
    # len // 4 per text, 0 for short or empty text; NULL text is not a row
    assert (r.rows, r.input_tokens, r.output_tokens) == (3, 2, 0)
    assert r.total_credits == pytest.approx(2e-6, abs=1e-18)
    assert r.total_cost == pytest.approx(6e-6, abs=1e-18)
    assert r.time_seconds == 0.0


def test_builtin_runs_empty_column_gives_no_rows(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert RU.builtin_runs(docs, "text").count() == 0


def test_score_texts_checkpointed(spark, catalog):
    docs = spark.createDataFrame([(1, "One. Two."), (2, "Three")], "doc_id long, text string")
    out = SC.score_texts(docs, "text", "doc_id", ["mistral-7b"], SC.echo_scorer_factory(),
                         catalog, checkpoint=True)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].input_tokens == 2 and rows[2].input_tokens == 1
    assert all(r.status == "success" for r in rows.values())


def test_score_texts_chunks_calls(spark, catalog):
    def factory():
        def score(model, prompts):
            # each reply carries the size of the call it came from
            return [f"{len(prompts)}:{len(p)}" for p in prompts]
        return score
    docs = spark.createDataFrame([(i, "t" * (i + 1)) for i in range(50)], "doc_id long, text string") \
        .coalesce(1)
    rows = SC.score_texts(docs, "text", "doc_id", ["mistral-7b"], factory, catalog, batch_size=7).collect()
    assert len(rows) == 50 and all(r.status == "success" for r in rows)
    sizes = [int(r.response.split(":")[0]) for r in rows]
    assert max(sizes) == 7 and sorted(set(sizes)) == [1, 7]      # 50 = 7 x 7 + 1
    assert {r.doc_id: r.response for r in rows}[9] == "7:10"


def test_scored_runs_feed_comparison_and_projection(spark, catalog):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(30)], "doc_id long, text string")
    def factory():                      # replies independent of the model
        return lambda model, prompts: [p[:12] for p in prompts]
    scored = SC.score_texts(docs, "text", "doc_id", ["mistral-7b", "llama3.1-70b"], factory, catalog)
    runs = RU.summarize_runs(scored, catalog, latency_col="latency_s")
    cmp = {r.model: r for r in RU.compare_runs(runs).collect()}
    assert set(cmp) == {"mistral-7b", "llama3.1-70b"} and all(r.rows == 30 for r in cmp.values())
    # same tokens on both models, so the cost ratio is the rate ratio (0.29 / 0.05)
    assert cmp["llama3.1-70b"].cost / cmp["mistral-7b"].cost == pytest.approx(5.8)
    proj = RU.project_scale(runs).collect()
    assert len(proj) == 2 * len(RU.SCALE_POINTS)
    best = {r.rows: r.cheapest_model for r in RU.best_per_scale(RU.project_scale(runs)).collect()}
    assert set(best.values()) == {"mistral-7b"}


def test_score_texts_keeps_string_keys(spark, catalog):
    docs = spark.createDataFrame([("q-1", "First. Second."), ("q-2", "Other")], "query_id string, text string")
    out = SC.score_texts(docs, "text", "query_id", ["mistral-7b"], SC.echo_scorer_factory(), catalog)
    assert dict(out.dtypes)["query_id"] == "string"
    assert sorted(r.query_id for r in out.collect()) == ["q-1", "q-2"]


@pytest.mark.parametrize("round_per_call", [False, True])
def test_from_results_variants_equal_the_fan_out(spark, round_per_call):
    res = TestData(spark, SF_SMALL).results()
    scaled = RU.scale_runs(res, round_per_call=round_per_call)
    m1 = sorted(map(tuple, RU.scale_matrix(scaled).collect()))
    m2 = sorted(map(tuple, RU.scale_matrix_from_results(res, round_per_call=round_per_call).collect()))
    assert m1 == m2
    s1 = [tuple(r) for r in RU.savings_at_scale(scaled).collect()]
    s2 = [tuple(r) for r in RU.savings_at_scale_from_results(res, round_per_call=round_per_call).collect()]
    assert s1 == s2
    batches = [10, 1000]
    s3 = [tuple(r) for r in RU.savings_at_scale(RU.scale_runs(res, batches)).collect()]
    s4 = [tuple(r) for r in RU.savings_at_scale_from_results(res, batches).collect()]
    assert s3 == s4 and s4[0][0] == 1000       # no 100,000 simulated: the largest size
