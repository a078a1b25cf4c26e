"""Linear daily-spend forecast.

One pass over the daily series: a window per key (the series is already one
row per key and day, so a key's frame is bounded by the number of days, never
by the number of raw usage rows) gives every row its key's first value, last
value, last date and length; the last day of each key then fans out into the
``horizon`` forecast rows with ``explode``. The daily aggregate is computed
once: no self-join, no second scan of the usage table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def forecast(daily: DataFrame, date_col: str = "usage_date", value_col: str = "credits",
             keys: list[str] | None = None, horizon: int = 30) -> DataFrame:
    """Actual rows plus ``horizon`` forecast rows per key.

    slope = (last - first) / (n - 1) over row positions (missing days are
    not gaps); forecast day i (0-based) is dated last_date + 1 + i with
    value ``max(last + slope * i, 0)`` (day 1 repeats the last actual).
    Keys with fewer than two days produce no rows.
    """
    keys = list(keys or [])
    # Without keys the whole (daily, hence small) series is one frame.
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    s = daily.select(
        *keys, F.col(date_col), F.col(value_col).cast("double").alias("_v"),
        F.count(F.lit(1)).over(w).alias("_n"),
        F.min_by(F.col(value_col).cast("double"), F.col(date_col)).over(w).alias("_first"),
        F.max_by(F.col(value_col).cast("double"), F.col(date_col)).over(w).alias("_last"),
        F.max(date_col).over(w).alias("_last_date"),
    ).where(F.col("_n") > 1)
    slope = (F.col("_last") - F.col("_first")) / (F.col("_n") - F.lit(1)).cast("double")
    actual = F.array(F.struct(F.col(date_col).alias("d"), F.col("_v").alias("v"),
                              F.lit("Actual").alias("t")))
    ahead = F.transform(
        F.sequence(F.lit(0), F.lit(horizon - 1)),
        lambda i: F.struct(F.date_add(F.col("_last_date"), i + 1).alias("d"),
                           F.greatest(F.col("_last") + slope * i.cast("double"), F.lit(0.0)).alias("v"),
                           F.lit("Forecast").alias("t")))
    rows = F.when(F.col(date_col) == F.col("_last_date"), F.concat(actual, ahead)).otherwise(actual)
    return (s.select(*keys, F.explode(rows).alias("_r"))
             .select(*keys, F.col("_r.d").alias(date_col), F.col("_r.v").alias(value_col),
                     F.col("_r.t").alias("type")))


def daily_totals(daily_by_service: DataFrame, date_col: str = "usage_date",
                 value_col: str = "credits", keys: list[str] | None = None,
                 exact_col: str | None = None) -> DataFrame:
    """Daily totals over services (A2), summing the exact twin when given."""
    from ..functions import money
    keys = list(keys or [])
    if exact_col:
        agg = money.credits_sum(exact_col).alias(value_col)
    else:
        agg = F.sum(value_col).alias(value_col)
    return daily_by_service.groupBy(*keys, date_col).agg(agg)
