"""Reports answered from exact daily partial sums.

``UsageRollups`` and ``MeteringRollups`` keep one small row for each day and
group: counts, token sums and exact credit sums. When rows arrive, late ones
included, only the days they touch are computed again from the logs and
replaced. A look-back of n x 24 hours begins inside a day: the whole days
after it come from the table, the part of that first day from the log, so the
answers equal those of a full scan.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..session import task_sizes
from ..sources.daily_table import DAY, DailyTable
from . import budget, usage as U
from .common import LOG_DATE, _as_str, credit_e8, dimension, model_label, ts_literal

#: Sketches of 2^12 registers: a standard error of 1.04 / 2^6, that is 1.6 %, in some 2 KB for each day and group.
SKETCH_LG = 12

#: Compressed bytes that a task of the upkeep reads from a shuffle, and from the written sums. Its sort of calls and its
#: table of groups, which are about as many as the calls, take some ten times that and stay in memory.
SHUFFLE_BYTES = 24 << 20
SPLIT_BYTES = 8 << 20
#: Late queries whose ids are sent to every scan of the calls (and 8 MB of them at most, see ``dimension``).
FEW_QUERIES = 400_000


def _time(as_of) -> datetime:
    return datetime.fromisoformat(_as_str(as_of).strip())


def _on_days(df: DataFrame, days: list[date], time_col: str = "start_time"):
    """Rows of the given days; bounds on the time (and the day partition) reach the scan."""
    low = ts_literal(df, time_col, f"{min(days)} 00:00:00")
    high = ts_literal(df, time_col, f"{max(days) + timedelta(days=1)} 00:00:00")
    cond = (F.col(time_col) >= low) & (F.col(time_col) < high) & F.to_date(time_col).isin(days)
    return df.where(cond & F.col(LOG_DATE).isin(days) if LOG_DATE in df.columns else cond)


def _days_of(df: DataFrame, time_col: str = "start_time") -> set[date]:
    """The distinct days: a line for each day of the log at most."""
    return {r[0] for r in df.select(F.to_date(time_col)).distinct().collect() if r[0]}


class _Window:
    """A look-back's first instant, the rest of its first day, and its first whole day."""

    def __init__(self, as_of, days: int):
        self.lower = _time(as_of) - timedelta(days=int(days))
        midnight = datetime.combine(self.lower.date(), datetime.min.time())
        self.part = None if self.lower == midnight else self.lower.date()
        self.first = self.lower.date() + timedelta(days=0 if self.part is None else 1)

    def rows(self, df: DataFrame, time_col: str = "start_time") -> DataFrame:
        """The log's rows of the part of a day at the window's begin."""
        return _on_days(df, [self.part], time_col).where(F.col(time_col) >= ts_literal(df, time_col, self.lower))


class UsageRollups:
    """Daily sums of the function-usage log joined to its query history.

    A call belongs to the day of its query's ``start_time``. ``path`` is a
    folder shared by all executors.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.sums = DailyTable(spark, f"{path}/calls", "model_name string, function_name string, user_name string, n long, tokens long, "
                                                       "credits_e8 decimal(38,0)")
        self.sketches = DailyTable(spark, f"{path}/users", "model_name string, users binary")

    # -- upkeep -----------------------------------------------------------------
    @staticmethod
    def calls(usage: DataFrame, history: DataFrame) -> DataFrame:
        """One row for each call with its day, user and exact credits."""
        h = history.where("start_time is not null").select("query_id", "user_name", F.to_date("start_time").alias(DAY))
        return usage.join(h, "query_id").select(DAY, "model_name", "function_name", "user_name", "tokens",
                                                credit_e8(usage, "token_credits").alias("credits_e8"))

    @staticmethod
    def calls_of(usage: DataFrame, history: DataFrame) -> DataFrame:
        """The usage rows that ``history`` may have, picked in the scan if its query ids are proven few, else all rows."""
        ids = history.select("query_id").distinct()
        few = dimension(ids, FEW_QUERIES)
        return usage if few is ids else usage.join(few, "query_id", "left_semi")

    @staticmethod
    def partial_sums(calls: DataFrame) -> DataFrame:
        return calls.groupBy(DAY, "model_name", "function_name", "user_name").agg(
            F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), money.exact_sum("credits_e8").alias("credits_e8"))

    @staticmethod
    def partial_sketches(calls: DataFrame) -> DataFrame:
        return calls.where("user_name is not null").groupBy(DAY, "model_name").agg(
            F.hll_sketch_agg("user_name", F.lit(SKETCH_LG)).alias("users"))

    def apply(self, usage: DataFrame, history: DataFrame, new_usage: DataFrame | None = None,
              new_history: DataFrame | None = None) -> set[date]:
        """Bring the days that new rows touch up to date; returns them.

        ``usage`` and ``history`` are the whole logs, the new rows included. A
        late call touches the day of its query, a late query its own day;
        without new rows all days are computed. Doing it twice changes nothing.
        The logs are joined once: a day's users are those of its sums.
        """
        every = new_usage is None and new_history is None
        if every:
            days = _days_of(history) | set(self.sums.days())
        else:
            days = _days_of(new_history) if new_history is not None else set()
            if new_usage is not None:
                ids = new_usage.select("query_id").distinct()
                days |= _days_of(history.join(ids, "query_id", "left_semi"))
        if days:
            touched = _on_days(history, sorted(days))
            with task_sizes(self.sums.spark, SHUFFLE_BYTES):
                self.sums.replace(days, self.partial_sums(self.calls(usage if every else self.calls_of(usage, touched), touched)))
            with task_sizes(self.sums.spark, SHUFFLE_BYTES, SPLIT_BYTES):
                self.sketches.replace(days, self.partial_sketches(self.sums.read(min(days), max(days))))
        return days

    # -- answers ----------------------------------------------------------------
    def window(self, usage: DataFrame, history: DataFrame, as_of, days: int) -> DataFrame:
        """Partial sums whose total is that of the look-back."""
        w = _Window(as_of, days)
        own = self.sums.read(first=w.first)
        return own.unionByName(self.partial_sums(self.calls(usage, w.rows(history)))) if w.part else own

    @staticmethod
    def _total(parts: DataFrame, *by, n: str) -> DataFrame:
        return parts.groupBy(*by).agg(F.sum("n").alias(n), F.sum("tokens").alias("total_tokens"),
                                      F.sum("credits_e8").cast(money.SUM_TYPE).alias("credits_e8"))

    def model_analysis(self, usage: DataFrame, history: DataFrame, as_of, days: int = 30,
                       label: str = "Specialized Function") -> DataFrame:
        """C9, as :func:`usage.model_analysis`."""
        parts = self.window(usage, history, as_of, days)
        return U.analysis_of_groups(self._total(parts, model_label("model_name", label).alias("model_name"), "function_name", n="invocations"))

    def usage_by_user(self, usage: DataFrame, history: DataFrame, as_of, days: int = 7) -> DataFrame:
        """C16, as :func:`usage.usage_by_user`."""
        g = self._total(self.window(usage, history, as_of, days), "user_name", "model_name", n="query_count")
        return (g.select("user_name", "model_name", "query_count", "total_tokens", money.e8_to_credits("credits_e8").alias("total_credits"))
                .orderBy(F.desc_nulls_last("total_credits"), "user_name", "model_name"))

    def usage_by_function(self, usage: DataFrame, history: DataFrame, as_of, days: int = 7) -> DataFrame:
        """C17, as :func:`usage.usage_by_function`."""
        g = self._total(self.window(usage, history, as_of, days), "function_name", "model_name", n="invocation_count")
        return (g.select("function_name", "model_name", "invocation_count", "total_tokens",
                         money.e8_to_credits("credits_e8").alias("total_credits"),
                         (F.col("total_tokens").cast("double") / F.col("invocation_count")).alias("avg_tokens_per_call"))
                .orderBy(F.desc_nulls_last("total_credits"), "function_name", "model_name"))

    def distinct_users(self, usage: DataFrame, history: DataFrame, as_of, days: int = 30) -> DataFrame:
        """(model_name, users): how many users called each model, estimated from merged daily sketches.

        The exact form is :func:`usage.distinct_users`; sums by day can't give it.
        """
        w = _Window(as_of, days)
        own = self.sketches.read(first=w.first)
        if w.part:
            own = own.unionByName(self.partial_sketches(self.calls(usage, w.rows(history))))
        return own.groupBy("model_name").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))


class MeteringRollups:
    """Daily credit sums of the metering log by service type."""

    def __init__(self, spark: SparkSession, path: str):
        self.sums = DailyTable(spark, f"{path}/metering", "service_type string, credits_e8 decimal(38,0)")

    @staticmethod
    def partial_sums(metering: DataFrame) -> DataFrame:
        return (metering.where("start_time is not null").select(F.to_date("start_time").alias(DAY), "service_type",
                                                                credit_e8(metering, "credits_used").alias("e8"))
                .groupBy(DAY, "service_type").agg(money.exact_sum("e8").alias("credits_e8")))

    def apply(self, metering: DataFrame, new: DataFrame | None = None) -> set[date]:
        """Bring the days of new rows (of all rows, without ``new``) up to date; ``metering`` is the whole log."""
        days = _days_of(metering) | set(self.sums.days()) if new is None else _days_of(new)
        if days:
            self.sums.replace(days, self.partial_sums(_on_days(metering, sorted(days))))
        return days

    def window(self, metering: DataFrame, as_of, days: int, service_type: str | None) -> DataFrame:
        """Partial sums whose total is that of the look-back."""
        w = _Window(as_of, days)
        own = self.sums.read(first=w.first)
        own = own.unionByName(self.partial_sums(w.rows(metering))) if w.part else own
        return own if service_type is None else own.where(F.col("service_type") == service_type)

    def daily_usage(self, metering: DataFrame, as_of, days: int = 30, service_type: str | None = "AI_SERVICES") -> DataFrame:
        """A1, as :func:`usage.daily_usage`."""
        parts = self.window(metering, as_of, days, service_type)
        return (parts.groupBy(F.col(DAY).alias("usage_date"), "service_type").agg(money.credits_sum("credits_e8").alias("credits"))
                .orderBy("usage_date", "service_type"))

    def usage_overview(self, metering: DataFrame, as_of, days: int = 30, price: float = 3.0, service_type: str = "AI_SERVICES") -> DataFrame:
        """C7, as :func:`usage.usage_overview`."""
        total = self.window(metering, as_of, days, service_type).agg(F.sum("credits_e8").cast(money.SUM_TYPE).alias("e8"))
        return U.overview_of_sum(total, days, price)

    def budget_status(self, metering: DataFrame, limits: DataFrame, as_of, service_type: str = "AI_SERVICES", price: float = 3.0) -> DataFrame:
        """C13, as :func:`budget.budget_status`."""
        today = _time(as_of).date()
        w = _Window(as_of, 7)
        first = min(w.first, today.replace(day=1))
        whole = self.sums.read(first=first).withColumn("_part", F.lit(False))
        if w.part:
            whole = whole.unionByName(self.partial_sums(w.rows(metering)).withColumn("_part", F.lit(True)))
        own, day, e8 = whole.where(F.col("service_type") == service_type), F.col(DAY), F.col("credits_e8")
        total = lambda cond: F.sum(F.when(cond, e8).otherwise(F.lit(0))).cast(money.SUM_TYPE)
        sums = own.agg(total(~F.col("_part") & (day == F.lit(today))).alias("d"), total(F.col("_part") | (day >= F.lit(w.first))).alias("w"),
                       total(~F.col("_part") & (day >= F.lit(today.replace(day=1)))).alias("m"))
        return budget.status_of_usage(budget.periods_of_sums(sums), limits, price)
