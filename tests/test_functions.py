"""Column helpers: prompt labels and lists (E17, E21, P6), the user tokenizer
UDF (F3), nested sessions (U4) and the savings invariant of C3."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metercast.functions import tokens as TK
from metercast.operators import costing as C
from metercast.operators import runs as RU
from metercast.operators import text_stats as TS


def test_labels_lists_and_truncation(spark):
    df = spark.createDataFrame([("SENTIMENT - Built-in", " a, b ,c", "x" * 101),
                                ("COMPLETE", "solo", "short")], "label string, cats string, t string")
    rows = df.select(TK.function_from_label("label").alias("f"), TK.category_list("cats").alias("c"),
                     TK.truncate_ellipsis("t", 100).alias("t")).collect()
    assert rows[0].f == "SENTIMENT" and rows[1].f == "COMPLETE"
    assert rows[0].c == ["a", "b", "c"] and rows[1].c == ["solo"]
    assert rows[0].t == "x" * 100 + "..." and rows[1].t == "short"


def test_user_tokenizer_udf_and_stats(spark):
    df = spark.createDataFrame([(1, "one two  three"), (2, ""), (3, None), (4, "four")],
                               "id long, text string")
    counter = TK.token_counter(TK.whitespace_tokenizer_factory())
    got = {r.id: r.n for r in df.select("id", counter("text").alias("n")).collect()}
    assert got == {1: 3, 2: 0, 3: None, 4: 1}
    s = TS.token_stats(df, "text", counter=counter).first()
    assert (s.sample_size, s.min_tokens, s.max_tokens) == (3, 0, 3)
    assert s.avg_tokens == pytest.approx(4 / 3)


def test_flatten_sessions_keeps_each_result(spark):
    schema = ("name string, test_type string, results array<struct<model:string, function:string, "
              "response:string, output_tokens:bigint, latency:double, cost:double, status:string>>")
    sessions = spark.createDataFrame([
        ("s1", "Sentiment", [("m1", "COMPLETE", "ok", 10, 0.5, 0.01, "success"),
                             ("m2", "COMPLETE", "boom", 0, 0.0, 0.0, "error")]),
        ("s2", "Summarize", [])], schema)
    flat = RU.flatten_sessions(sessions)
    assert flat.count() == 2 and set(flat.columns) >= {"test", "model", "status"}
    assert RU.successful(flat).count() == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 10**6), st.integers(0, 10**5)),
                min_size=1, max_size=30))
def test_calculator_savings_never_negative(spark, catalog, work):
    rows = [(i, a, b, n) for i, (a, b, n) in enumerate(work)]
    df = spark.createDataFrame(rows, "work_id long, input_tokens_per_request long, "
                                     "output_tokens_per_request long, requests long")
    out = C.cost_calculator(df, catalog).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.savings_usd >= 0 and 0 <= r.savings_pct <= 100
        assert r.cheapest_cost_usd <= r.most_expensive_cost_usd and r.n_models == 22


def test_display_formats(spark):
    from metercast.functions import display as D
    r = spark.createDataFrame([(1234.5678, 12.345, 1234567, "medium")],
                              "v double, p double, n long, t string").select(
        D.usd("v").alias("u"), D.credits("v").alias("c"), D.pct("p").alias("p"),
        D.count("n").alias("n"), D.title("t").alias("t")).first()
    assert (r.u, r.c, r.p, r.n, r.t) == ("$1,234.57", "1,234.5678", "12.3%", "1,234,567", "Medium")


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2_000_000), st.sampled_from([3, 5, 29, 150, 750, 3750])),
                min_size=1, max_size=200),
       st.integers(1, 16))
def test_exact_credit_sums_ignore_partitioning(spark, rows, parts):
    from metercast.functions import money
    df = spark.createDataFrame(rows, "tokens long, rate_centi long").repartition(parts)
    got = df.agg(money.credits_sum(money.token_credits_e8("tokens", "rate_centi")).alias("c")).first().c
    assert got == float(sum(t * r for t, r in rows)) / 1e8


def test_classification_prompt_then_fill(spark):
    r = spark.createDataFrame([("Positive, Negative", "great product")], "cats string, body string").select(
        F.replace(TK.classification_prompt("cats"), F.lit("{text}"), F.col("body")).alias("p")).first()
    assert r.p == ("Classify the following text into one of these categories: [Positive, Negative]. "
                   "Respond with only the category name.\n\nText: great product")
