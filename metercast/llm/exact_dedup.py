"""Exact deduplication with DataFrame functions only.

One aggregate groups the texts by their 128-bit content hash and, inside a
hash, by their bytes, so texts that merely collide stay apart. The partial
aggregate runs before the shuffle: a group of copies, however large, leaves
each map task as one row. The narrow (id, hashes) rows then look their group
up; that join has unique keys on the group side, so adaptive execution can
split a hot group's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


def content_hash(norm: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(norm.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                hash_fn=content_hash) -> DataFrame:
    """Mark the copies of equal texts (equal after lower-casing A-Z only).

    ``keep`` says which id of a group stays, ``"min"`` or ``"max"``.

    Returns one row per input row: the id, keep_id, group_size, kept,
    text_sha256 (of the normalised text). A null text counts as the empty
    text; empty texts are copies of each other. Rows that repeat an id repeat
    in the result with the same values and all count in group_size. A null id
    stays only in a group that has no other. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    keyed = base.select("_id", "_norm", hash_fn(F.col("_norm")).alias("_h"))
    best = F.max("_id") if keep == "max" else F.min("_id")
    groups = (keyed.groupBy("_h", "_norm").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("_h", F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"), "keep_id", "group_size"))
    rows = keyed.select("_id", "_h", F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"))
    return (rows.join(groups, ["_h", "_sha"])
            .select(F.col("_id").alias(id_col), "keep_id", "group_size",
                    F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("_sha").alias("text_sha256")))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
