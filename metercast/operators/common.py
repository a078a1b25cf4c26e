"""Shared building blocks: look-back predicates, exact credit columns, joins."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import money


def _as_str(as_of) -> str:
    if isinstance(as_of, datetime):
        return as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(as_of, date):
        return as_of.strftime("%Y-%m-%d 00:00:00")
    return str(as_of)


def ts_literal(df: DataFrame, col: str, as_of) -> Column:
    """``as_of`` as a timestamp literal of the same flavour as ``df[col]``
    (timestamp_ntz logs compare to an ntz literal, so the filter folds to a
    constant and is pushed into the parquet scan)."""
    dt = df.schema[col].dataType
    t = "timestamp_ntz" if isinstance(dt, T.TimestampNTZType) else "timestamp"
    return F.lit(_as_str(as_of)).cast(t)


# Partition column written by ``sinks.write_usage_log``: the day of the row's
# timestamp. Never a column of the source tables themselves.
LOG_DATE = "log_date"


def since(df: DataFrame, col: str, as_of, days: int) -> Column:
    """Rolling look-back ``col >= as_of - days`` (n x 24 h, no upper bound; P1).

    On a log partitioned by day (``log_date`` column) the implied bound
    ``log_date >= day(as_of - days)`` is added, so whole days are pruned
    before any file is opened."""
    lower = ts_literal(df, col, as_of) - F.make_dt_interval(F.lit(int(days)))
    return at_or_after(df, col, lower)


def at_or_after(df: DataFrame, col: str, lower: Column) -> Column:
    """``col >= lower`` plus the implied day bound on a day-partitioned log."""
    cond = F.col(col) >= lower
    if LOG_DATE in df.columns and col != LOG_DATE:
        cond = cond & (F.col(LOG_DATE) >= F.to_date(lower))
    return cond


def date_literal(as_of) -> Column:
    return F.to_date(F.lit(_as_str(as_of)[:10]))


def since_date(col: str, as_of, days: int) -> Column:
    """Look-back on a date column: ``col >= as_of_date - days``."""
    return F.col(col) >= F.date_sub(date_literal(as_of), int(days))


def credit_e8(df: DataFrame, col: str) -> Column:
    """Exact credit units of ``col``: its ``_e8`` twin when the loader
    provides one, else the value rounded to 1e-8 credit."""
    if f"{col}_e8" in df.columns:
        return F.col(f"{col}_e8")
    return money.from_decimal_credits(F.col(col))


def model_label(col: str = "model_name", label: str = "Specialized Function") -> Column:
    """``COALESCE(NULLIF(model, ''), label)``."""
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(label))


# Largest dimension broadcast to every task. The price catalog, rate lists,
# keyword lists and budget limits are far below it.
DIM_MAX_ROWS = 100_000
DIM_MAX_BYTES = 8 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size of a frame; exact for local relations."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dimension(df: DataFrame, max_rows: int = DIM_MAX_ROWS,
              of: DataFrame | list[DataFrame] | None = None) -> DataFrame:
    """Broadcast hint for a dimension whose size is proven small.

    Proof is either that the frame is derived only from local relations
    (tables built on the driver, such as the fixed catalog; ``of`` names the
    frames ``df`` filters, projects or combines, whose product bounds its
    size) of at most ``DIM_MAX_BYTES`` each, or a bounded probe that reads at
    most ``max_rows + 1`` rows of ``df`` and sums their size. Beyond the bound no hint is given
    and Spark plans a shuffled join (adaptive execution may still broadcast
    it at runtime); the result is the same.
    """
    srcs = [df] if of is None else (of if isinstance(of, list) else [of])
    if all(s.isLocal() for s in srcs):
        return F.broadcast(df) if all(plan_bytes(s) <= DIM_MAX_BYTES for s in srcs) else df
    probe = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("size")).first()
    return F.broadcast(df) if probe["n"] <= max_rows and (probe["size"] or 0) <= DIM_MAX_BYTES else df


def top_k(df: DataFrame, order: list, k: int, fan_in: int = 200) -> DataFrame:
    """Exact top-``k`` by ``order`` in two levels.

    ``orderBy().limit(k)`` keeps ``k`` rows per input partition and merges
    them all in one task; on a 100 TB scan that is hundreds of thousands of
    partitions. Here the partitions' ``k`` first rows (a limit inside the
    window is pushed below its shuffle) are merged in ``fan_in`` groups of
    partitions, and only ``fan_in * k`` rows meet in the last task. Spark
    pushes such limits up to ``spark.sql.optimizer.windowGroupLimitThreshold``
    rows; a larger ``k`` is the result size the caller asked for, and takes
    the plain form.
    """
    k = int(k)
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return df.orderBy(*order).limit(k)
    cols = df.columns
    grouped = df.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(int(fan_in))))
    w = Window.partitionBy("_group").orderBy(*order)
    return grouped.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select(*cols).orderBy(*order).limit(k)


def with_history(usage: DataFrame, qh: DataFrame, as_of, days: int,
                 cols: tuple[str, ...] = ()) -> DataFrame:
    """Usage joined to the query history of the look-back window.

    Inner equi-join on query_id: usage rows without history drop, many usage
    rows per query all stay. The window predicate sits on the history side
    and is pushed into its scan; no broadcast hint: adaptive execution turns
    the join into a broadcast only when the filtered history is measured
    small at runtime, and splits skewed query ids otherwise.
    """
    h = qh.where(since(qh, "start_time", as_of, days)).select("query_id", *cols)
    return usage.join(h, "query_id", "inner")
