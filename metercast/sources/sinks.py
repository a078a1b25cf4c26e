"""Sinks (S16, S17) and the partitioned usage-log writer.

Writers are distributed: every task writes its own part files; nothing is
coalesced into one task or collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import LOG_DATE
from ..operators.runs import result_groups


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line per part file."""
    df.write.mode(mode).option("header", True).csv(path)


def results_summary(results: DataFrame) -> DataFrame:
    """The export summary as one row (S17): number of tests and results, the
    cheapest and the fastest successful result (ties: model, function, test
    order). Reads the reduced result groups (one hash aggregate over the
    results), so the distinct count and arg-mins never touch every row."""
    g = result_groups(results)
    ok = F.col("n_ok") > 0
    key = [F.col("model").alias("m"), F.col("function").alias("f"), F.col("test").alias("t")]
    a = g.agg(
        F.countDistinct("test").alias("tests"),
        F.coalesce(F.sum("n_ok"), F.lit(0)).cast("long").alias("results"),
        F.min(F.when(ok, F.struct(F.col("min_cost").alias("v"), *key))).alias("c"),
        F.min(F.when(ok, F.struct(F.col("min_latency").alias("v"), *key))).alias("l"))
    return a.select(
        "tests", "results",
        F.struct(F.col("c.m").alias("model"), F.col("c.v").alias("cost")).alias("cheapest"),
        F.struct(F.col("l.m").alias("model"), F.col("l.v").alias("latency")).alias("fastest"))


def write_summary(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON summary ``{tests, results, cheapest{model,cost}, fastest{model,latency}}``
    (S17), written by the one task that holds the one-row aggregate."""
    results_summary(results).write.mode(mode).json(path)


def write_usage_log(df: DataFrame, path: str, time_col: str = "start_time",
                    mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> None:
    """Write a usage / metering log partitioned by ``log_date`` (the day of
    ``time_col``) so that the look-back filters prune whole days at read
    time (:func:`metercast.operators.common.since` adds the implied
    ``log_date`` bound).

    No shuffle: each task sorts its own rows by day and writes one file per
    day it holds, so a day that carries a third of all rows is still spread
    over every task (no hot writer); ``maxRecordsPerFile`` bounds file size.

    The default overwrite is dynamic: only the days present in ``df`` are
    replaced, so re-running a failed or repeated load of some days is
    idempotent instead of appending duplicates.
    """
    out = df.withColumn(LOG_DATE, F.to_date(time_col))
    (out.sortWithinPartitions(LOG_DATE)
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(LOG_DATE)
        .option("maxRecordsPerFile", max_records_per_file)
        .parquet(path))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None,
                   mode: str = "overwrite") -> None:
    """Save ``df`` as a catalog table bucketed and sorted by ``key``.

    Two tables bucketed the same way on the join key (the usage log and the
    query history on ``query_id``) join bucket by bucket: the sort-merge join
    reads co-located files and neither side is shuffled. ``path`` places the
    files (a shared folder on a cluster); the catalog keeps the bucketing.
    """
    w = df.write.mode(mode).format("parquet").bucketBy(int(buckets), key).sortBy(key)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
