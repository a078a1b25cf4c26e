"""Token statistics of a text column and prompt filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from .common import top_k


def _stats(df: DataFrame, tok: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("sample_size"),
                  F.avg(tok).alias("avg_tokens"),
                  F.min(tok).alias("min_tokens"),
                  F.max(tok).alias("max_tokens"),
                  F.round(F.stddev_samp(tok), 6).alias("stddev_tokens"))


def token_stats(df: DataFrame, text_col: str, counter=None) -> DataFrame:
    """n, mean, min, max and sample stddev of estimated tokens over the whole
    non-null column (E1 per row), or of exact counts with ``counter`` (F3,
    :func:`metercast.functions.tokens.token_counter`)."""
    col = F.col(text_col)
    t = df.where(col.isNotNull()).select(
        (counter(col) if counter is not None else tokens.est_tokens(col)).alias("t"))
    return _stats(t, "t")


def sample_rows(df: DataFrame, key: str, n: int = 1000) -> DataFrame:
    """A deterministic fixed-size sample (T7): the ``n`` rows with the
    smallest md5 of the key. A per-partition top-k whose final merge is
    bounded by the cluster's parallelism (:func:`common.top_k`)."""
    return top_k(df, [F.md5(F.col(key).cast("string")), F.col(key)], n)


def sampled_token_stats(df: DataFrame, text_col: str, key: str, n: int = 1000) -> DataFrame:
    """Token statistics of a ``n``-row sample (C18, the sampling operator)."""
    # the estimate is made before the top-k: texts don't travel
    t = df.where(F.col(text_col).isNotNull()).select(key, tokens.est_tokens(F.col(text_col)).alias("t"))
    return _stats(sample_rows(t, key, n), "t")


def fill_prompts(df: DataFrame, text_col: str, template: str, key: str) -> DataFrame:
    """Per row: the filled prompt's md5, length and estimated input tokens
    (E16: literal ``{text}`` replacement)."""
    p = tokens.fill_prompt(template, F.col(text_col))
    return df.where(F.col(text_col).isNotNull()).select(
        key, F.md5(p).alias("prompt_md5"), F.length(p).alias("prompt_chars"),
        tokens.est_input_tokens(p).alias("prompt_tokens"),
        tokens.est_input_tokens(F.col(text_col)).alias("text_tokens"))
