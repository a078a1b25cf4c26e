"""Rows with changed texts: what the pipeline's stages apply to whole documents."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import apply_bitmap


def new_texts(joined: DataFrame, like: DataFrame, extra: list[str], change: Callable) -> DataFrame:
    """Rows with the columns of ``like`` and changed texts: ``change(text as UTF-8, *values of extra)``.

    Rows whose first extra value is null keep their text, null texts too;
    n_chars follows the text. Characters that a change leaves in part are left out.
    """
    names = like.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            more = [b.column(len(names) + k).to_pylist() for k in range(len(extra))]
            new = [t if t is None or x[0] is None else change(t.encode(), *x).decode("utf-8", "ignore")
                   for t, *x in zip(texts, *more)]
            cols = [pa.array(new, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = joined.select(*names, *extra).mapInArrow(run, like.schema)
    return out.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)) if "n_chars" in names else out


def without_lines(text: bytes, bitmap: bytes) -> bytes:
    """The lines that a keep bitmap leaves."""
    return apply_bitmap(text, bitmap)[0]


def without_runs(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The bytes outside the removed runs."""
    return b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)]))
