"""Training corpus from raw documents: five stages, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``.
Ids identify documents: of rows that repeat an id all stay or go together.
A row without an id is judged by its own text and shares nothing with other
rows: line dedup, the join and the suffix arrays leave it as it is. Other nulls,
empty texts and empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metercast.llm import jaccard_join, line_dedup, packing, quality_rules, suffix_dedup
from metercast.llm.common import documents, small_batches, work_dir, written
from metercast.llm.texts import new_texts, without_lines, without_runs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned rules reject."""
    small_batches(spark)
    folder = work_dir(spark)
    stats = written(quality_rules.text_statistics(docs), "statistics", folder)
    rules = quality_rules.train_rules(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    with_id = docs.join(quality_rules.verdicts(stats, rules).where("kept").select("doc_id"), "doc_id", "left_semi")
    # rows without an id get a number in a table of their own, so that a verdict finds its row
    numbered = written(docs.where("doc_id IS NULL").withColumn("_stage_row", F.monotonically_increasing_id()), "without_id", folder)
    judged = quality_rules.verdicts(quality_rules.text_statistics(numbered, "_stage_row"), rules)
    without_id = numbered.join(judged.where("kept").select(F.col("doc_id").alias("_stage_row")), "_stage_row", "left_semi")
    return with_id.select(docs.columns).unionByName(without_id.select(docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds as well."""
    small_batches(spark)
    bitmaps = line_dedup.line_dedup(docs).select("doc_id", F.col("keep_bitmap").alias("_stage_bitmap"))
    return new_texts(docs.join(bitmaps, "doc_id", "left"), docs, ["_stage_bitmap"], without_lines)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8).
    Rows without an id are in no group and stay."""
    small_batches(spark)
    groups = jaccard_join.near_duplicates(docs, percent=80, size=5)
    heads = docs.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    return heads.unionByName(docs.where("doc_id IS NULL"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that a document with a smaller id holds as well (whole characters stay)."""
    small_batches(spark)
    spans = (suffix_dedup.removed_spans(docs).where(F.size("starts") > 0)
             .select("doc_id", F.col("starts").alias("_stage_starts"), F.col("ends").alias("_stage_ends"))
             .dropDuplicates(["doc_id"]))
    return new_texts(docs.join(spans, "doc_id", "left"), docs, ["_stage_starts", "_stage_ends"], without_runs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences."""
    small_batches(spark)
    # workers hold what the stages before have left as well: fewer words are remembered here
    return packing.pack_documents(docs, cache_words=300_000, literal=False)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates),
          ("suffix_array_dedup", passages), ("best_fit_packing", pack)]

#: The learned rules and the packing are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    folder = work_dir(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
