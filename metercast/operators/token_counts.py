"""Exact token counts of whole columns by a model's own vocabulary.

A text is counted once however often it occurs: rows are reduced to their
distinct texts by a shuffle on the text's hash (copies meet before it in each
task), a tokenizer counts these in Arrow batches, and the counts go back to
the rows by hash, without the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens

_HASH, _N = "_text_hash", "n_tokens"


def _hashed(text_col: str):
    return F.unhex(F.sha2(F.col(text_col), 256)).alias(_HASH)


def _distinct_counts(df: DataFrame, text_col: str, tokenizer_factory: Callable) -> DataFrame:
    texts = (df.where(F.col(text_col).isNotNull()).select(_hashed(text_col), F.col(text_col).alias("_text"))
             .dropDuplicates([_HASH]))
    return texts.select(_HASH, tokens.token_counter(tokenizer_factory)("_text").alias(_N))


def exact_token_counts(df: DataFrame, text_col: str, key_col: str, tokenizer_factory: Callable) -> DataFrame:
    """(key, n_tokens) of every row: null for a null text, 0 for an empty one. Repeated rows repeat."""
    rows = df.select(F.col(key_col), _hashed(text_col))
    return rows.join(_distinct_counts(df, text_col, tokenizer_factory), _HASH, "left").select(key_col, _N)


def exact_token_stats(df: DataFrame, text_col: str, group_col: str, tokenizer_factory: Callable) -> DataFrame:
    """Per group (null is a group): texts, distinct texts, total, mean, smallest and largest token count of the non-null texts.

    Copies are summed before they meet their count: a text that a third of
    all rows hold is one row of the join for each group.
    """
    copies = (df.where(F.col(text_col).isNotNull()).groupBy(F.col(group_col), _hashed(text_col))
              .agg(F.count(F.lit(1)).alias("_copies")))
    j = copies.join(_distinct_counts(df, text_col, tokenizer_factory), _HASH)
    total = F.sum(F.col("_copies") * F.col(_N))
    return j.groupBy(group_col).agg(
        F.sum("_copies").alias("texts"), F.count(F.lit(1)).alias("distinct_texts"), total.alias("total_tokens"),
        (total / F.sum("_copies")).alias("avg_tokens"), F.min(_N).alias("min_tokens"), F.max(_N).alias("max_tokens"))


def vocabulary_tokenizer_factory(path: str | None = None):
    """Counts by a vocabulary file of the ``tokenizers`` library, special tokens' strings taken as text.

    ``path`` (on every machine) defaults to the byte-level BPE installed with
    ``public_tokenizers``. Texts are encoded one by one, so memory is bounded
    by the longest.
    """
    def factory():
        from tokenizers import Tokenizer
        file = path
        if file is None:
            import public_tokenizers
            file = public_tokenizers.path("byte_bpe_50k.json")
        tokenizer = Tokenizer.from_file(file)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    return factory
