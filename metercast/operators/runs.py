"""Analytics over logged model runs and test results (C21-C31, W1, U3-U6,
A15-A19, E9, E23, T9, P16, P17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bands, money, tokens
from .common import dimension

# Projection points and batch sizes of the scale steps.
SCALE_POINTS = [1000, 5000, 10000, 25000, 50000, 100000]
QUICK_SCALES = [1000, 10000, 100000]
DEFAULT_BATCHES = [100, 1000, 10000, 100000]
ALLOWED_BATCHES = [10, 50, 100, 500, 1000, 5000, 10000, 50000, 100000, 500000, 1000000]
BUILTIN_CALL_USD = 0.0001
BUILTIN_FUNCTIONS = ["SENTIMENT", "SUMMARIZE"]


def _points(values) -> Column:
    return F.explode(F.array(*[F.lit(int(v)).cast("long") for v in values]))


def successful(results: DataFrame) -> DataFrame:
    """Keep successful runs."""
    return results.where(F.col("status") == "success")


# -- A19 runs from per-row results, E7 built-in function runs -------------------------

BUILTIN_CREDITS_PER_TOKEN_E8 = 100  # fixed value: 1e-6 credits per input token (E7)
REALTIME_BUILTINS = ["SENTIMENT", "SUMMARIZE", "TRANSLATE", "CLASSIFY_TEXT"]


def summarize_runs(results: DataFrame, catalog: DataFrame, price: float = 3.0,
                   latency_col: str = "latency", response_col: str = "response",
                   strict: bool = True) -> DataFrame:
    """One run row per model over the successful per-row results (A19):
    rows, token sums, credits and cost, summed latency and a sample output
    (the first 500 characters of a response). A model that the catalog lacks
    raises when ``strict``; otherwise its run stays, without credits and cost.

    Cost is linear in tokens, so it is priced once per model from the exact
    token sums (identical to summing per-row costs, without carrying money
    through the shuffle); the catalog joins the per-model aggregate, not the
    rows. An exact ``latency_centi`` column is summed when present.
    """
    s = successful(results)
    t = (money.exact_sum("latency_centi").cast("double") / F.lit(100.0)
         if "latency_centi" in s.columns else F.sum(latency_col).cast("double"))
    g = s.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        t.alias("time_seconds"),
        F.min(F.left(F.col(response_col), F.lit(500))).alias("sample_output"))
    c = dimension(catalog.select(F.col("model").alias("_cat_model"), "in_centi", "out_centi"), of=catalog)
    e8 = (F.col("input_tokens").cast(money.SUM_TYPE) * F.col("in_centi")
          + F.col("output_tokens").cast(money.SUM_TYPE) * F.col("out_centi"))
    e10 = e8 * F.lit(money.price_centi(price))
    model = F.col("model")
    if strict:  # the check rides on a selected column, so it cannot be pruned
        model = F.when(F.col("_cat_model").isNull(),
                       F.raise_error(F.concat(F.lit("Unknown model: "), F.coalesce(model, F.lit("NULL"))))).otherwise(model)
    return g.join(c, F.col("model") == F.col("_cat_model"), "left").select(
        model.alias("model"), "rows", "input_tokens", "output_tokens",
        money.e8_to_credits(e8).alias("total_credits"), money.e10_to_usd(e10).alias("total_cost"),
        "time_seconds", "sample_output", e10.alias("cost_e10"))


def builtin_runs(texts: DataFrame, text_col: str, functions=REALTIME_BUILTINS,
                 price: float = 3.0) -> DataFrame:
    """Run rows of the built-in text functions over a whole text column (E7):
    input tokens ``len // 4`` per non-null text (E3), no output tokens, a
    flat 1e-6 credits per input token whatever the function. The column is
    aggregated once; the function list only fans out that one row. Wall
    time is not measured without a service call: ``time_seconds`` is 0."""
    g = texts.where(F.col(text_col).isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(tokens.est_output_tokens(F.col(text_col))), F.lit(0).cast("long"))
         .alias("input_tokens"))
    e8 = F.col("input_tokens").cast(money.SUM_TYPE) * F.lit(BUILTIN_CREDITS_PER_TOKEN_E8)
    e10 = e8 * F.lit(money.price_centi(price))
    fn = F.explode(F.array(*[F.lit(f) for f in functions])).alias("model")
    return g.where(F.col("rows") > 0).select(
        fn, "rows", "input_tokens", F.lit(0).cast("long").alias("output_tokens"),
        money.e8_to_credits(e8).alias("total_credits"), money.e10_to_usd(e10).alias("total_cost"),
        F.lit(0.0).alias("time_seconds"), F.lit(None).cast("string").alias("sample_output"),
        e10.alias("cost_e10"))


# -- C21 run comparison ------------------------------------------------------------

def compare_runs(runs: DataFrame) -> DataFrame:
    """Per run: tokens, credits, cost, time and throughput."""
    tok = F.col("input_tokens") + F.col("output_tokens")
    return runs.select("model", "rows", "input_tokens", "output_tokens",
                       F.col("total_credits").alias("credits"), F.col("total_cost").alias("cost"),
                       "time_seconds",
                       money.safe_div(tok.cast("double"), F.col("time_seconds")).alias("tokens_per_sec"))


def run_totals(runs: DataFrame) -> DataFrame:
    """Totals across runs (A18) and the cheapest / fastest run (T9; ties go
    to the smaller model name)."""
    cost = (money.usd_sum("cost_e10") if "cost_e10" in runs.columns else F.sum("total_cost"))
    return runs.agg(
        F.count(F.lit(1)).alias("models_tested"), F.sum("rows").alias("total_rows"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        cost.alias("total_cost"),
        F.min(F.struct(F.col("total_cost").alias("c"), F.col("model").alias("m"))).alias("lo"),
        F.min(F.struct(F.col("time_seconds").alias("t"), F.col("model").alias("m"))).alias("fa"),
    ).select("models_tested", "total_rows", "total_tokens", "total_cost",
             F.col("lo.m").alias("cheapest_model"), F.col("lo.c").alias("cheapest_cost"),
             F.col("fa.m").alias("fastest_model"), F.col("fa.t").alias("fastest_seconds"))


# -- C22-C25 projections -------------------------------------------------------------

def project_scale(runs: DataFrame, points=SCALE_POINTS) -> DataFrame:
    """Per run and scale point: tokens (truncated), cost and minutes by
    linear extrapolation of the per-row figures (E23). Runs with 0 rows are
    skipped."""
    r = runs.where(F.col("rows") > 0)
    tpr = (F.col("input_tokens") + F.col("output_tokens")).cast("double") / F.col("rows")
    cpr = F.col("total_cost") / F.col("rows")
    spr = F.col("time_seconds") / F.col("rows")
    p = r.select("model", tpr.alias("_t"), cpr.alias("_c"), spr.alias("_s"), _points(points).alias("rows"))
    return p.select("model", "rows",
                    F.floor(F.col("_t") * F.col("rows")).cast("long").alias("est_tokens"),
                    (F.col("_c") * F.col("rows")).alias("est_cost"),
                    (F.col("_s") * F.col("rows") / F.lit(60.0)).alias("est_time_min"))


def projection_pivot(proj: DataFrame, models: list[str]) -> DataFrame:
    """Scale x model cost table (C23, U5). Pivot values are explicit; a
    duplicate (rows, model) pair fails the query like the wide reshape it
    stands for."""
    g = proj.groupBy("rows", "model").agg(F.count(F.lit(1)).alias("_n"), F.max("est_cost").alias("_c"))
    g = g.select("rows", "model",
                 F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate (rows, model) in projection")))
                  .otherwise(F.col("_c")).alias("est_cost"))
    return g.groupBy("rows").pivot("model", list(models)).agg(F.first("est_cost"))


def best_per_scale(proj: DataFrame, scales=QUICK_SCALES) -> DataFrame:
    """Cheapest model per scale and its saving against the dearest."""
    p = proj.where(F.col("rows").isin([int(s) for s in scales]))
    g = p.groupBy("rows").agg(
        F.count(F.lit(1)).alias("n_models"),
        F.min(F.struct(F.col("est_cost").alias("c"), F.col("model").alias("m"))).alias("lo"),
        F.max("est_cost").alias("dearest_cost"))
    return g.select("rows", "n_models", F.col("lo.m").alias("cheapest_model"),
                    F.col("lo.c").alias("cheapest_cost"), "dearest_cost",
                    (F.col("dearest_cost") - F.col("lo.c")).alias("savings"))


def project_to_table(runs: DataFrame, table: DataFrame, text_col: str) -> DataFrame:
    """Cost and time of running each model on the whole table (C25): the
    non-null row count (one global aggregate) times the per-row figures,
    ranked, with the saving against the dearest model."""
    # a count of the column: the scan can take it from the file footers
    n = table.agg(F.count(text_col).alias("table_rows"))
    # ``n`` is one row by construction (a global count)
    r = runs.where(F.col("rows") > 0).crossJoin(F.broadcast(n))
    r = r.select("model", "table_rows",
                 (F.col("total_cost") / F.col("rows") * F.col("table_rows")).alias("est_cost"),
                 (F.col("time_seconds") / F.col("rows") * F.col("table_rows") / F.lit(60.0)).alias("est_time_min"))
    # one row per model: the dearest cost comes from a window over that small
    # table instead of a second aggregate (which would recompute the runs)
    mx = F.max("est_cost").over(Window.partitionBy(F.lit(0)))
    j = r.withColumn("max_cost", mx)
    return j.select("model", "table_rows", "est_cost", "est_time_min",
                    (F.col("max_cost") - F.col("est_cost")).alias("savings_vs_dearest"),
                    bands.savings_pct(F.col("est_cost"), F.col("max_cost")).alias("savings_pct")
                    ).orderBy("est_cost", "model")


# -- C26-C31 over flattened results -------------------------------------------------

def flatten_sessions(sessions: DataFrame) -> DataFrame:
    """Nested test sessions -> one row per (test, result) (U4)."""
    return sessions.select(F.col("name").alias("test"), "test_type",
                           F.explode("results").alias("r")).select("test", "test_type", "r.*")


def _check_batches(batches) -> list[int]:
    bad = [b for b in batches if int(b) not in ALLOWED_BATCHES]
    if bad:
        raise ValueError(f"batch sizes {bad} not in {ALLOWED_BATCHES}")
    return [int(b) for b in batches]


def _per_call(round_per_call: bool) -> tuple[Column, Column]:
    """Per-call cost (double) and its exact 1e-10 USD units; rounded to
    cents first when ``round_per_call`` (Q4)."""
    if round_per_call:
        per_call = money.round_half_up(F.col("cost"), 2)
        return per_call, F.round(per_call * F.lit(float(money.E10))).cast(money.SUM_TYPE)
    return F.col("cost"), F.col("cost_e10").cast(money.SUM_TYPE)


def scale_runs(results: DataFrame, batches=DEFAULT_BATCHES, round_per_call: bool = False) -> DataFrame:
    """Each successful result x each batch size (C26, J4): total cost =
    per-call cost x batch. ``round_per_call`` first rounds the call to cents
    as the shipped wizard does (sub-cent calls then project to 0)."""
    _check_batches(batches)
    s = successful(results)
    per_call, e10 = _per_call(round_per_call)
    p = s.select("test", "model", "function",
                 per_call.alias("cost_per_row"), e10.alias("_e10"), _points(batches).alias("rows"))
    return p.select("test", "model", "function", "rows",
                    (F.col("cost_per_row") * F.col("rows")).alias("total_cost"), "cost_per_row",
                    (F.col("_e10") * F.col("rows")).alias("total_cost_e10"))


def scale_matrix(scaled: DataFrame, batches=DEFAULT_BATCHES) -> DataFrame:
    """Mean total cost by model x batch size (C27, A15, U6), from exact sums."""
    g = scaled.groupBy("model", "rows").agg(
        (money.usd_sum("total_cost_e10") / F.count(F.lit(1))).alias("mean_cost"))
    return g.groupBy("model").pivot("rows", [int(b) for b in batches]).agg(F.first("mean_cost"))


def scale_matrix_from_results(results: DataFrame, batches=DEFAULT_BATCHES,
                              round_per_call: bool = False) -> DataFrame:
    """``scale_matrix(scale_runs(results))`` without multiplying the rows by
    the batch sizes: the cost at ``n`` calls is n x the per-call cost, so the
    per-model mean is summed once and only the per-model rows fan out."""
    sizes = _check_batches(batches)
    _, e10 = _per_call(round_per_call)
    g = successful(results).groupBy("model").agg(money.exact_sum(e10).alias("_s"),
                                                 F.count(F.lit(1)).alias("_n"))
    p = g.select("model", "_s", "_n", _points(sizes).alias("rows"))
    p = p.select("model", "rows",
                 (money.e10_to_usd(F.col("_s") * F.col("rows")) / F.col("_n")).alias("mean_cost"))
    return p.groupBy("model").pivot("rows", sizes).agg(F.first("mean_cost"))


def savings_at_scale(scaled: DataFrame, target: int = 100000) -> DataFrame:
    """At ``target`` rows if simulated, else the largest size (P17): the
    cheapest and dearest result and the difference (C30).

    The arg-min/arg-max runs on pre-aggregated rows: a hash aggregate per
    (size, model, function, test) keeps only numeric extremes (partial
    aggregation collapses the rows map-side), and the struct extremes per
    size are taken over that small set. The size is then picked among the
    few aggregated rows (one per simulated size)."""
    pre = scaled.groupBy("rows", "model", "function", "test").agg(
        F.min("total_cost_e10").alias("_lo"), F.max("total_cost_e10").alias("_hi"))
    key = [F.col("model").alias("m"), F.col("function").alias("f"), F.col("test").alias("t")]
    g = pre.groupBy("rows").agg(
        F.min(F.struct(F.col("_lo").alias("c"), *key)).alias("lo"),
        F.max(F.struct(F.col("_hi").alias("c"), *key)).alias("hi"))
    w = Window.partitionBy(F.lit(0))
    pick = F.coalesce(F.max(F.when(F.col("rows") == target, F.col("rows"))).over(w),
                      F.max("rows").over(w))
    g = g.withColumn("_pick", pick).where(F.col("rows") == F.col("_pick"))
    return g.select("rows", F.col("lo.m").alias("cheapest_model"),
                    money.e10_to_usd("lo.c").alias("cheapest_cost"),
                    F.col("hi.m").alias("dearest_model"), money.e10_to_usd("hi.c").alias("dearest_cost"),
                    money.e10_to_usd(F.col("hi.c") - F.col("lo.c")).alias("savings"))


def savings_at_scale_from_results(results: DataFrame, batches=DEFAULT_BATCHES,
                                  target: int = 100000, round_per_call: bool = False) -> DataFrame:
    """``savings_at_scale(scale_runs(results))`` without the fan-out: at any
    batch size the cheapest and dearest result are those of the per-call
    cost, so the extremes are found once (hash pre-aggregate, then a struct
    extreme over the small groups) and scaled by the picked size (P17: the
    target if simulated, else the largest)."""
    sizes = _check_batches(batches)
    pick = target if target in sizes else max(sizes)
    _, e10 = _per_call(round_per_call)
    s = successful(results).select("test", "model", "function", e10.alias("_e10"))
    pre = s.groupBy("model", "function", "test").agg(F.min("_e10").alias("_lo"),
                                                     F.max("_e10").alias("_hi"))
    key = [F.col("model").alias("m"), F.col("function").alias("f"), F.col("test").alias("t")]
    g = pre.agg(F.min(F.struct(F.col("_lo").alias("c"), *key)).alias("lo"),
                F.max(F.struct(F.col("_hi").alias("c"), *key)).alias("hi")).where(F.col("lo").isNotNull())
    n = F.lit(pick).cast("long")
    return g.select(n.alias("rows"), F.col("lo.m").alias("cheapest_model"),
                    money.e10_to_usd(F.col("lo.c") * n).alias("cheapest_cost"),
                    F.col("hi.m").alias("dearest_model"), money.e10_to_usd(F.col("hi.c") * n).alias("dearest_cost"),
                    money.e10_to_usd((F.col("hi.c") - F.col("lo.c")) * n).alias("savings"))


def result_groups(results: DataFrame) -> DataFrame:
    """Results reduced to one row per (test, model, function): successful
    runs, their cheapest cost and fastest latency and the latency sum. A hash
    aggregate with partial aggregation; the per-result reports below (counts,
    distinct counts, arg-mins) then read this small frame instead of every
    result row."""
    ok = F.col("status") == "success"
    lat = (money.exact_sum(F.when(ok, F.col("latency_centi")))
           if "latency_centi" in results.columns else F.sum(F.when(ok, F.col("latency"))))
    return results.groupBy("test", "model", "function").agg(
        F.count(F.when(ok, F.lit(1))).alias("n_ok"),
        F.min(F.when(ok, F.col("cost"))).alias("min_cost"),
        F.min(F.when(ok, F.col("latency"))).alias("min_latency"),
        lat.alias("latency_sum"))


def compare_all(results: DataFrame) -> DataFrame:
    """Counts of tests, successful runs, models and functions (C28, A16),
    with the distinct counts taken over the reduced result groups."""
    g = result_groups(results)
    ok = F.col("n_ok") > 0
    return g.agg(
        F.countDistinct("test").alias("total_tests"),
        F.coalesce(F.sum("n_ok"), F.lit(0)).cast("long").alias("total_runs"),
        F.countDistinct(F.when(ok, F.col("model"))).alias("models_tested"),
        F.countDistinct(F.when(ok, F.col("function"))).alias("functions_used"))


def results_table(results: DataFrame) -> DataFrame:
    """Successful runs without the response text (C28, P18), with the type of
    their test where the results carry one."""
    kind = ["test_type"] if "test_type" in results.columns else []
    return successful(results).select("test", *kind, "model", "function", "latency", "cost", "output_tokens")


def winners(results: DataFrame) -> DataFrame:
    """Cheapest and fastest successful run (C29, T9); ties go to the first in
    (model, function, test) order. Arg-mins over the reduced result groups."""
    g = result_groups(results).where(F.col("n_ok") > 0)
    key = [F.col("model").alias("m"), F.col("function").alias("f"), F.col("test").alias("t")]
    scale = 100.0 if "latency_centi" in results.columns else 1.0
    a = g.agg(F.min(F.struct(F.col("min_cost").alias("v"), *key)).alias("c"),
              F.min(F.struct(F.col("min_latency").alias("v"), *key)).alias("l"),
              F.sum("latency_sum").alias("_lat"), F.sum("n_ok").alias("_n"))
    return a.select(F.col("c.m").alias("cheapest_model"), F.col("c.f").alias("cheapest_function"),
                    F.col("c.v").alias("cheapest_cost"),
                    F.col("l.m").alias("fastest_model"), F.col("l.f").alias("fastest_function"),
                    F.col("l.v").alias("fastest_latency"),
                    (F.col("_lat").cast("double") / F.lit(scale) / F.col("_n")).alias("avg_latency"),
                    F.col("_n").cast("long").alias("runs"))


def prompt_vs_builtin(results: DataFrame, builtin: DataFrame, functions=BUILTIN_FUNCTIONS,
                      call_usd: float = BUILTIN_CALL_USD) -> DataFrame:
    """Prompt-based runs next to the logged runs of the built-in functions
    (C31, U3): model ``"<model> (via <FUNC>)"``, their own response and
    latency, a flat ``call_usd`` per call (E8). The union is aggregated per
    function and variant; distinct models come from its partial aggregates."""
    names = list(functions)
    latency = (lambda d: F.col("latency_centi") if "latency_centi" in d.columns
               else F.round(F.col("latency") * 100).cast("long"))
    prompt, other = successful(results), successful(builtin)
    prompt = prompt.where(F.col("function").isin(names)).select(
        "function", F.lit("prompt").alias("variant"), "model", "output_tokens",
        F.col("cost_e10").cast(money.SUM_TYPE).alias("_e10"), latency(prompt).alias("_lat"))
    other = other.where(F.col("function").isin(names)).select(
        "function", F.lit("builtin").alias("variant"), "model", tokens.est_tokens(F.col("response")).alias("output_tokens"),
        F.lit(int(round(call_usd * money.E10))).cast(money.SUM_TYPE).alias("_e10"), latency(other).alias("_lat"))
    # one row for each model first, so that counting models needs no second shuffle of the runs
    g = prompt.unionByName(other).groupBy("function", "variant", "model").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("output_tokens").alias("_out"), money.exact_sum("_e10").alias("_e10"),
        money.exact_sum("_lat").alias("_lat"))
    g = g.groupBy("function", "variant").agg(
        F.sum("_n").alias("runs"), F.count("model").alias("models"), F.sum("_out").alias("output_tokens"),
        money.exact_sum("_e10").alias("_e10"), money.exact_sum("_lat").alias("_lat"))
    return g.select("function", "variant", "runs", "models", "output_tokens", money.e10_to_usd("_e10").alias("total_cost"),
                    (F.col("_lat").cast("double") / F.lit(100.0) / F.col("runs")).alias("avg_latency"))
