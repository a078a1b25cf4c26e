"""Scoring that can be taken up again (F1, F2): a ledger of the calls already made.

The ledger is a folder of Parquet rows (prompt hash, model, response, latency,
status). A run asks it first, calls a model only for the (prompt, model) pairs
that no run has finished, and appends what it gets. Prompts go out in chunks,
one task each, and a task's file becomes visible when the task ends, whatever
becomes of the job: a lost driver or executor repeats the chunks that were
under way, no others. Every row stands for itself, so what a dead run leaves
is used as it is; a pair that two runs called at once counts once.

Equal prompts are one call for each model.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens
from .costing import with_cost
from .scoring import Scorer, _score_chunk

_ROWS = "prompt_hash binary, model string, response string, latency_s double, status string"


class ScoringLedger:
    """Finished calls under ``path``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _runs(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def calls(self) -> DataFrame:
        """One row for each (prompt_hash, model): a success if there is one, else an error."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], _ROWS)
        rows = self.spark.read.schema(_ROWS).parquet(*runs)
        best = F.min(F.struct(F.col("status") != "success", "status", "response", "latency_s")).alias("b")
        return rows.groupBy("prompt_hash", "model").agg(best).select("prompt_hash", "model", "b.response", "b.latency_s", "b.status")

    def finished(self, retry_errors: bool = True) -> DataFrame:
        """prompt_hash and the models that need no call (errors do, unless told otherwise)."""
        calls = self.calls().where("status = 'success'") if retry_errors else self.calls()
        return calls.groupBy("prompt_hash").agg(F.collect_set("model").alias("done"))

    def append(self, prompts: DataFrame, models: list[str], scorer_factory: Callable[[], Scorer], batch_size: int = 256,
               chunk_prompts: int = 10_000, retry_errors: bool = True) -> int:
        """Call every model of ``models`` for the prompts (prompt_hash, prompt) that lack it. Returns how many
        prompts had calls to make. A chunk of at most about ``chunk_prompts`` prompts is what a lost task repeats."""
        asked = F.array(*[F.lit(m) for m in models]).cast("array<string>")
        todo = prompts.withColumn("models", asked)
        if self._runs():
            todo = (todo.join(self.finished(retry_errors), "prompt_hash", "left")
                    .withColumn("models", F.array_except(asked, F.coalesce("done", F.array().cast("array<string>"))))
                    .where(F.size("models") > 0).drop("done"))
        n = todo.agg(F.count_distinct("prompt_hash")).first()[0] if models else 0
        if not n:
            return 0
        chunks = max(-(-n // int(chunk_prompts)), min(n, self.spark.sparkContext.defaultParallelism))
        scored = (todo.dropDuplicates(["prompt_hash"]).repartition(int(chunks), "prompt_hash")
                  .mapInPandas(_calls_of_partition(scorer_factory, int(batch_size)), _ROWS))
        # this committer moves a task's files into place when the task ends, not when the job does
        scored.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/run-{uuid.uuid4().hex}")
        return n


def _calls_of_partition(scorer_factory: Callable[[], Scorer], batch_size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in batches:
            for model in sorted({m for wanted in pdf["models"] for m in wanted}):
                own = pdf[[model in wanted for wanted in pdf["models"]]]
                for lo in range(0, len(own), batch_size):
                    part = own.iloc[lo:lo + batch_size]
                    response, latency, status = _score_chunk(scorer, model, part["prompt"].tolist())
                    yield pd.DataFrame({"prompt_hash": part["prompt_hash"].values, "model": model, "response": response,
                                        "latency_s": latency, "status": status})
    return run


def score_texts_resumable(df: DataFrame, text_col: str, key_col: str, models: list[str], scorer_factory: Callable[[], Scorer],
                          catalog: DataFrame, ledger: ScoringLedger, template: str | None = None, price: float = 3.0,
                          count_template: bool = False, batch_size: int = 256, chunk_prompts: int = 10_000,
                          retry_errors: bool = True) -> DataFrame:
    """The rows of :func:`scoring.score_texts` through a ledger: calls that it holds are not made again.

    The calls are made now; the returned frame reads them from the ledger.
    Null texts have no row, an empty table gives none, rows that repeat a key
    or a text each have theirs. A model that the catalog lacks is not called
    and its rows are error rows; so are failed calls, which the next run
    tries again unless ``retry_errors`` is off.
    """
    text = F.col(text_col)
    prompt = text if template is None else tokens.fill_prompt(template, text)
    src = df.where(text.isNotNull()).select(
        F.col(key_col).alias("key"), prompt.alias("prompt"), F.length(prompt).cast("long").alias("prompt_chars"),
        tokens.est_input_tokens(text).alias("text_tokens"), F.unhex(F.sha2(prompt, 256)).alias("prompt_hash"))
    models = list(dict.fromkeys(models))
    known = {r[0] for r in catalog.where(F.col("model").isin(models)).select("model").distinct().collect()}
    ledger.append(src.select("prompt_hash", "prompt"), [m for m in models if m in known], scorer_factory, batch_size,
                  chunk_prompts, retry_errors)

    calls = ledger.calls().where(F.col("model").isin(models))
    asked = F.explode(F.array(*[F.lit(m) for m in models]).cast("array<string>")).alias("model")
    j = src.select("key", "prompt_hash", "prompt_chars", "text_tokens", asked).join(calls, ["prompt_hash", "model"], "left")
    status = F.when(F.col("model").isin(sorted(known)), F.col("status")).otherwise(F.lit("error"))
    ok, zero = F.col("status") == "success", F.lit(0).cast("long")
    in_tok = tokens.est_tokens_of_length("prompt_chars") if count_template else F.col("text_tokens")
    j = j.withColumn("status", status).select(
        F.col("key").alias(key_col), "model",
        F.when(F.col("model").isin(sorted(known)), F.col("response")).otherwise(F.concat(F.lit("Unknown model: "), "model")).alias("response"),
        "status", F.when(ok, F.col("latency_s")).otherwise(F.lit(0.0)).alias("latency_s"),
        F.when(ok, in_tok).otherwise(zero).alias("input_tokens"),
        F.when(ok, tokens.est_output_tokens(F.col("response"))).otherwise(zero).alias("output_tokens"))
    return with_cost(j, catalog, price=price, strict=False, keep_unknown=True)
