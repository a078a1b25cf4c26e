"""Token estimates and prompt helpers as native column expressions (E1-E4,
E16, E17, E21). ``length`` counts code points, as the estimate requires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _quarter(c) -> Column:
    return F.floor(F.length(_c(c)) / F.lit(4)).cast("long")


def est_tokens(text) -> Column:
    """General estimate: ``max(1, len // 4)``; empty text gives 1."""
    return F.greatest(F.lit(1).cast("long"), _quarter(text))


def est_input_tokens(text) -> Column:
    """Prompt input: ``max(1, len // 4)`` when the text is non-empty, else 0."""
    n = F.coalesce(F.length(_c(text)), F.lit(0))
    return F.when(n > 0, F.greatest(F.lit(1).cast("long"), _quarter(text))).otherwise(F.lit(0).cast("long"))


def est_tokens_of_length(n) -> Column:
    """E2 from a length: ``max(1, n // 4)`` when ``n > 0``, else 0 (used when
    the length of a filled prompt is known without building it)."""
    n = _c(n)
    return F.when(n > 0, F.greatest(F.lit(1).cast("long"), F.floor(n / F.lit(4)).cast("long"))) \
            .otherwise(F.lit(0).cast("long"))


def est_output_tokens(text) -> Column:
    """Output / built-in input: ``len // 4`` when non-empty, else 0; may be 0."""
    return F.coalesce(_quarter(_c(text).cast("string")), F.lit(0).cast("long"))


def expected_output_tokens(test_type) -> Column:
    """Expected output tokens by task label, case-sensitive."""
    t = _c(test_type)
    return (F.when(t.contains("Sentiment") | t.contains("Classify"), F.lit(10).cast("long"))
             .when(t.contains("Summarize"), F.lit(100).cast("long"))
             .otherwise(F.lit(150).cast("long")))


def fill_prompt(template: str, text) -> Column:
    """Literal ``{text}`` substitution, never a regex."""
    return F.replace(F.lit(template), F.lit("{text}"), _c(text))


# The classification prompt of the test wizard; ``{categories}``
# is the comma list as typed, ``{text}`` the text placeholder.
CLASSIFY_PROMPT = ("Classify the following text into one of these categories: [{categories}]. "
                   "Respond with only the category name.\n\nText: {text}")


def classification_prompt(categories) -> Column:
    """The classification prompt template for a comma list of categories
    (still holding ``{text}`` for :func:`fill_prompt`-style filling)."""
    return F.replace(F.lit(CLASSIFY_PROMPT), F.lit("{categories}"), _c(categories))


def category_list(csv) -> Column:
    """Comma list -> trimmed array."""
    return F.transform(F.split(_c(csv), ","), lambda x: F.trim(x))


def function_from_label(label) -> Column:
    """Text before the first ' - ' of a test label."""
    return F.split_part(_c(label), F.lit(" - "), F.lit(1))


def truncate_ellipsis(text, n: int = 100) -> Column:
    """First ``n`` characters plus '...' when longer."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


# -- F3: exact counts with a user-supplied tokenizer ------------------------------

def token_counter(tokenizer_factory):
    """Column function counting tokens with the user's tokenizer.

    ``tokenizer_factory()`` returns ``count(texts: list[str]) -> list[int]``.
    Arrow-batched pandas UDF in iterator form: the tokenizer is built once
    per task (not per row or batch) and fed whole batches; NULL text gives a
    NULL count. The native estimates above stay the default: this is for
    callers who need a model's own tokenizer.
    """
    @F.pandas_udf("long")
    def _count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = tokenizer_factory()
        for s in batches:
            mask = s.isna()
            n = pd.Series(count(s.fillna("").astype(str).tolist()), index=s.index, dtype="Int64")
            n[mask] = pd.NA
            yield n

    def apply(text) -> Column:
        return _count(_c(text))
    return apply


def whitespace_tokenizer_factory():
    """A stand-in tokenizer: whitespace-separated words (tests, examples)."""
    def factory():
        return lambda texts: [len(t.split()) for t in texts]
    return factory
