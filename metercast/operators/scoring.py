"""Batch text scoring with a user-supplied model client (F1, F2).

The hosted per-row model calls of the dashboard become one distributed job:
prompts, their lengths and the fan-out to models are column expressions;
``mapInPandas`` hands Arrow batches of prompts to the scorer, which is created
once per task. Token estimates and the catalog cost are column expressions
again.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money, tokens
from .costing import with_cost

# scorer_factory() -> scorer(model, prompts: list[str]) -> list[str | Exception]
Scorer = Callable[[str, list], list]

_OUT_FIELDS = [
    T.StructField("model", T.StringType()),
    T.StructField("text_tokens", T.LongType()),
    T.StructField("prompt_chars", T.LongType()),
    T.StructField("response", T.StringType()),
    T.StructField("latency_s", T.DoubleType()),
    T.StructField("status", T.StringType()),
]


def _out_schema(key_type: T.DataType) -> T.StructType:
    """Scored rows: the source key (its own type) plus the scorer's output."""
    return T.StructType([T.StructField("key", key_type)] + _OUT_FIELDS)


def _score_chunk(scorer: Scorer, model: str, prompts: list) -> tuple[list, list, list]:
    """One scorer call for a chunk. The scorer reports a bad row by an
    exception in that row's place (F2); a call that raises makes all its rows
    error rows. No call is repeated: calls are paid for."""
    t0 = time.perf_counter()
    try:
        out = list(scorer(model, prompts))
        if len(out) != len(prompts):
            raise ValueError("scorer returned a different number of rows")
    except Exception as e:  # noqa: BLE001 - an error row holds the message
        out = [e] * len(prompts)
    per = (time.perf_counter() - t0) / max(len(prompts), 1)
    bad = [isinstance(r, Exception) for r in out]
    return ([str(r) if b else r for r, b in zip(out, bad)], [0.0 if b else per for b in bad],
            ["error" if b else "success" for b in bad])


def _score_partition(scorer_factory: Callable[[], Scorer], batch_size: int, models: list[tuple[str, bool]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()  # once per task
        for pdf in batches:
            for model, known in models:  # the prompts came over once for all models
                for lo in range(0, len(pdf), batch_size):
                    part = pdf.iloc[lo:lo + batch_size]
                    if known:
                        resp, lat, st = _score_chunk(scorer, model, part["prompt"].tolist())
                    else:
                        resp, lat, st = f"Unknown model: {model}", 0.0, "error"
                    yield pd.DataFrame({
                        "key": part["key"].values, "model": model,
                        "text_tokens": part["text_tokens"].values, "prompt_chars": part["prompt_chars"].values,
                        "response": resp, "latency_s": lat, "status": st})
    return run


def score_texts(df: DataFrame, text_col: str, key_col: str, models: list[str],
                scorer_factory: Callable[[], Scorer], catalog: DataFrame,
                template: str | None = None, price: float = 3.0,
                count_template: bool = False, checkpoint: bool = False,
                batch_size: int = 256, parallelism: int | None = None) -> DataFrame:
    """Run every non-null text through every model with the user's scorer.

    Per (key, model): response, status ('error' rows carry the whole message
    and zero tokens, latency and cost), latency, estimated input tokens (E2
    on the text, or on the prompt with ``count_template``), output tokens
    (E3) and the catalog cost (C1). A model that the catalog lacks is not
    called; its rows are error rows.

    Prompts and lengths are made by column expressions; a prompt crosses to
    Python once and is fanned out to the models there, and ``parallelism``
    spreads the texts over that many tasks. With ``checkpoint`` the scored rows are written
    to the shared checkpoint folder, so a lost executor never repeats the
    model calls. The scorer gets at most ``batch_size`` prompts per call; it
    is created once per task.
    """
    text = F.col(text_col)
    prompt = text if template is None else tokens.fill_prompt(template, text)
    src = df.where(text.isNotNull()).select(
        F.col(key_col).alias("key"), prompt.alias("prompt"), F.length(prompt).cast("long").alias("prompt_chars"),
        tokens.est_input_tokens(text).alias("text_tokens"))
    # of the models asked for, those that the catalog has: as many rows as ``models`` at most
    known = {r[0] for r in catalog.where(F.col("model").isin(models)).select("model").distinct().collect()}
    if parallelism:
        src = src.repartition(int(parallelism))
    scored = src.mapInPandas(_score_partition(scorer_factory, int(batch_size), [(m, m in known) for m in models]), _out_schema(df.schema[key_col].dataType))
    if checkpoint:
        from ..session import materialize
        scored = materialize(scored)
    ok = F.col("status") == "success"
    zero = F.lit(0).cast("long")
    in_tok = tokens.est_tokens_of_length("prompt_chars") if count_template else F.col("text_tokens")
    j = scored.select(F.col("key").alias(key_col), "model", "response", "status",
                      F.when(ok, F.col("latency_s")).otherwise(F.lit(0.0)).alias("latency_s"),
                      F.when(ok, in_tok).otherwise(zero).alias("input_tokens"),
                      F.when(ok, tokens.est_output_tokens(F.col("response"))).otherwise(zero).alias("output_tokens"))
    return with_cost(j, catalog, price=price, strict=False, keep_unknown=True)


def result_rows(scored: DataFrame, test: str, test_type: str) -> DataFrame:
    """Scored rows as test results, the input of the comparison and scale
    operators (C26-C30): test, its type, model, function (``COMPLETE``, or
    what the type names before ' - '), response, tokens, latency, cost."""
    # whole 1e-10 USD at rates and prices of two decimals
    e10 = F.round(F.col("total_cost_usd_raw").cast("decimal(38,16)") * F.lit(money.E10), 0)
    function = test_type.split(" - ")[0] if " - " in test_type else "COMPLETE"
    return scored.select(
        F.lit(test).alias("test"), F.lit(test_type).alias("test_type"), "model", F.lit(function).alias("function"), "response",
        "input_tokens", "output_tokens", F.col("latency_s").alias("latency"), F.col("total_cost_usd_raw").alias("cost"),
        "status", e10.cast(money.SUM_TYPE).alias("cost_e10"))


def echo_scorer_factory(fail_every: int = 0) -> Callable[[], Scorer]:
    """A deterministic stand-in scorer for tests and smoke runs: it replies
    with the length and the md5 of the whole prompt; with ``fail_every`` it
    reports an error for prompts whose length is divisible by it."""
    def factory() -> Scorer:
        def score(model: str, prompts: list) -> list:
            return [RuntimeError(f"model {model} failed") if fail_every and len(p) % fail_every == 0 else
                    f"[{model}] {len(p)} characters, md5 {hashlib.md5(p.encode()).hexdigest()}" for p in prompts]
        return score
    return factory
